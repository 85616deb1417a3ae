"""Personal data by weak supervision, with DataFrame functions alone.

Candidates are the matches of the base patterns (those that fail their check as well) and of some looser
ones (local phone numbers, national ids of three countries, account numbers, IPv6, keys and tokens, spelt-out mail, names). Four labellers
vote on each (for, against, nothing): the pattern's own check, gazetteers (mail endings, calling codes, issuer
digits, reserved nets, key prefixes, given names), the words before it, and what stands right beside it. The votes of all candidates of all documents are counted by their combination, a table
whose size the labellers bound; expectation maximisation over those counts gives each labeller's
reliability and each combination's probability. With these as soft labels a naive Bayes classifier over
the span's own features is trained, and it decides on the candidates that no base rule took. Base spans
always stay; an added span never overlaps one, nor a private key that was added.

Everything is computed inside a document's row: no shuffle but that of the counts, no key to be hot.
A match's place is the summed length of the gaps (``split``) and matches (``regexp_extract_all``) before
it; the patterns are written so that Java's engine neither recurses nor scans a run twice.

Defined results: a null or empty text has no spans and the digest of the empty string; a text of any length is read
whole; rows stay as they come, repeated ones too; other columns are kept whatever their names, one with the name of a
result is replaced; without any candidate in the whole table nothing is added; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_prefix, text_or_empty

#: The contract's base patterns, in its order.
BASE = ("email", "ip", "card", "phone")
GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Steven|Andrew|Kenneth|George|Joshua|Kevin|Brian|Edward|Ronald|Timothy|Jason|Jeffrey|Gary|Ryan|"
    "Nicholas|Eric|Stephen|Jonathan|Larry|Scott|Benjamin|Samuel|Gregory|Patrick|Alexander|Jack|Dennis|Jerry|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|"
    "Ashley|Kimberly|Emily|Donna|Michelle|Carol|Amanda|Melissa|Deborah|Stephanie|Rebecca|Laura|Helen|Sharon|Cynthia|Kathleen|Amy|Angela|Anna|Ruth|Brenda|Pamela|Nicole|Katherine|Samantha|Christine|Emma|Catherine|"
    "Virginia|Rachel|Janet|Maria|Heather|Diane|Julie|Peter|Hans|Klaus|Wolfgang|Helmut|Werner|Manfred|Dieter|Gerhard|Stefan|Andreas|Matthias|Tobias|Sabine|Petra|Monika|Renate|Ursula|Ingrid|Heike|Brigitte|Gisela|"
    "Jean|Pierre|Michel|Philippe|Alain|Jacques|Bernard|Luc|Nicolas|Laurent|Olivier|Marie|Nathalie|Isabelle|Sylvie|Monique|Sophie|Camille|Claire|Juan|Carlos|Luis|Miguel|Javier|Antonio|Manuel|Francisco|Alejandro|"
    "Carmen|Ana|Isabel|Dolores|Pilar|Teresa|Marta|Elena|Lucas|Hugo|Pablo|Diego|Sergio|Paulo|Marco|Giulia|Francesca|Giovanni|Luca|Ahmed|Mohammed|Fatima|Wei|Yuki|Olga|Ivan|Natasha"
)
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Señor|Señora"
#: (kind, pattern, the text must hold: SQL over _t and _digit)
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(_t, '@')"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "_digit"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "_digit"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "_digit AND contains(_t, '+')"),
    ("phone_local", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])", "_digit"),
    ("national_id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-HJ-NP-TV-Z]|[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])(?![0-9A-Za-z-])", "_digit"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}+(?: ?[0-9A-Z]{1,3}+)?(?![0-9A-Za-z])", "_digit"),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "contains(_t, ':')"),
    ("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}", "_digit"),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?", "contains(_t, '-----BEGIN ')"),
    ("email_spelt", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9]{2,24}+)++", "contains(lower(_t), '(at)') OR contains(lower(_t), '[at]')"),
    ("name", rf"(?<![A-Za-z])(?=[A-Z])(?:(?:{TITLES})\.? [A-Z][a-z]{{1,30}}+ [A-Z][a-z]{{1,30}}+|(?:{GIVEN}) [A-Z][a-z]{{1,30}}+)(?![a-z])", "true"),
)
KINDS = tuple(k for k, _, _ in PATTERNS)
#: Gazetteers and cue words: small fixed lists, parameters of the labellers.
ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|nl|ch|at|eu|us|ca|au|jp|cn|in|br|mx"
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
LEADS = "AKIA|ASIA|ghp_|gho_|glpat-|sk_|pk_|sk-|xox[abp]-|eyJ|AIza|SG"
CUES = "mail|contact|phone|tel|call|fax|mobile|cell|address|addr|server|host|card|visa|credit|payment|account|ssn|write to"
COUNTER = "version|license|licence|isbn|issn|section|chapter|order|invoice|token|hash|sha|commit|release"
#: The same for some kinds of their own.
OWN_CUES = {
    "secret": ("token|key|secret|password|passwd|pwd|auth|bearer|credential|api", "sha|sha256|commit|hash|digest|checksum|md5|etag|revision|path|href|src|url"),
    "private_key": ("key|secret|private", "public|example"),
    "iban": ("iban|account|bank|konto|transfer|compte|cuenta|payment", COUNTER),
    "ipv6": ("server|host|address|addr|ip|client|from", "time|at|duration"),
    "name": ("by|dear|from|contact|author|signed|regards|mr|mrs|ms|dr|name|called|met|said", "saint|st|street|avenue|mount|port|lake|fort|university|school|church|company"),
}
BEFORE = 40
ACCEPT = 0.9


def _running(n: str) -> str:
    """SQL for the running sums of an array of integers, in blocks, so that no long array is copied for each element."""
    return f"""transform(array({n}), n -> transform(array(
        transform(transform(sequence(0, greatest(0, (size(n) - 1) DIV 256)), b -> slice(n, b * 256 + 1, 256)),
            o -> aggregate(slice(o, 2, 256), slice(o, 1, 1), (a, x) -> concat(a, array(element_at(a, -1) + x))))),
        i -> flatten(zip_with(i, slice(aggregate(transform(i, o -> coalesce(try_element_at(o, -1), 0)), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x))), 1, size(i)),
            (o, base) -> transform(o, x -> x + base))))[0])[0]"""


def _spans(found: str, gaps: str) -> str:
    """Array of a pattern's matches with their places and surroundings; both names are columns."""
    return f"""transform(array({_running(f"transform({found}, (m, i) -> length({gaps}[i]) + length(m))")}), e -> transform({found}, (m, i) -> named_struct(
        'm', m, 's', e[i] - length(m), 'e', e[i], 'before', right({gaps}[i], {BEFORE}), 'after', left({gaps}[i + 1], 1))))[0]"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = f"reverse({_digits(m)})"
    return f"""aggregate(transform(sequence(1, greatest(1, length({d}))), i -> CAST(substring({d}, i, 1) AS INT) * IF(i % 2 = 0, 2, 1)),
        0, (a, x) -> a + x - IF(x > 9, 9, 0)) % 10 = 0"""


def _mod97(m: str) -> str:
    """SQL: the check number of an account is right (its first four characters behind the others, letters as 10 to 35)."""
    bare = f"replace({m}, ' ', '')"
    return f"""aggregate(filter(split(concat(substring({bare}, 5), left({bare}, 4)), ''), c -> c <> ''), 0,
        (a, c) -> IF(c RLIKE '[0-9]', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"""


def _valid(kind: str) -> str:
    """SQL over x.m: does a match pass its kind's check?"""
    parts = "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', left(ltrim('0', p), 3)) AS INT) <= 255)"
    return {
        "email": "true",
        "ip": parts,
        "card": f"CASE WHEN length({_digits('x.m')}) BETWEEN 16 AND 19 THEN {_luhn('x.m')} ELSE false END",
        "phone": f"length({_digits('x.m')}) BETWEEN 8 AND 15",
        "national_id": """CASE WHEN x.m RLIKE '^[0-9]{8}' THEN substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(left(x.m, 8) AS INT) % 23 + 1, 1) = right(x.m, 1)
            ELSE NOT (x.m LIKE '000%' OR x.m LIKE '666%' OR x.m LIKE '9%' OR x.m LIKE '%-00-%' OR x.m LIKE '%-0000') END""",
        "iban": f"CASE WHEN length(replace(x.m, ' ', '')) BETWEEN 15 AND 34 THEN {_mod97('x.m')} ELSE false END",
        "ipv6": "CASE WHEN contains(x.m, '::') THEN size(split(x.m, '::')) = 2 AND size(split(x.m, ':')) <= 8 ELSE size(split(x.m, ':')) = 8 END",
        "secret": "x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]' AND size(array_distinct(split(left(x.m, 64), ''))) >= 8",
    }.get(kind, "true")


def _plausible(kind: str) -> str:
    """SQL over x.m: may a match that failed its check still hold personal data? Runs of any length that
    are too long may: a number and what follows it, joined by a space. Short or ill-formed ones are not candidates."""
    return {
        "card": f"CASE WHEN length({_digits('x.m')}) >= 20 THEN {_luhn(f'left({_digits("x.m")}, 16)')} ELSE false END",
        "phone": f"length({_digits('x.m')}) >= 16",
        "national_id": "x.m LIKE '___-__-____'",
    }.get(kind, "false")


def _gazetteer(kind: str) -> str:
    return {
        "email": f"IF(lower(x.m) RLIKE '[.]({ENDINGS})$', 1, 0)",
        "email_spelt": f"IF(lower(x.m) RLIKE '({ENDINGS})$', 1, -1)",
        "ip": "IF(x.m RLIKE '^(0|127|255|22[4-9]|23[0-9])[.]', -1, 0)",
        "ipv6": "IF(lower(x.m) RLIKE '^(fe80|ff|::1$)', -1, 0)",
        "card": "IF(x.m RLIKE '^[3-6]', 1, -1)",
        "phone": f"IF({_digits('x.m')} RLIKE '^({CODES})', 1, -1)",
        "phone_local": "IF(x.m RLIKE '^[(]?[2-9]', 1, -1)",
        "secret": f"CASE WHEN x.m RLIKE '^({LEADS})' THEN 1 WHEN x.m RLIKE '^(/|[A-Za-z]+([-_/][A-Za-z]+)+[-_/]?[0-9]*$)' THEN -1 ELSE 0 END",
        "private_key": "IF(x.m LIKE '%-----END %', 1, 0)",
        "name": f"IF(x.m RLIKE '(^| )({GIVEN}) ', 1, 0)",
    }.get(kind, "0")


def _cue(kind: str) -> str:
    cues, counter = OWN_CUES.get(kind, (CUES, COUNTER))
    return f"CASE WHEN lower(x.before) RLIKE '(^|[^a-z])({counter})[^a-z]*$' THEN -1 WHEN lower(x.before) RLIKE '(^|[^a-z])({cues})' THEN 1 ELSE 0 END"


def _side(kind: str) -> str:
    if kind in ("secret", "private_key"):
        return """CASE WHEN x.before RLIKE '[=:]\\\\s*["\\']?$' OR x.after IN ('"', '\\'') THEN 1 WHEN x.before RLIKE '[A-Za-z0-9./?&#%-]$' OR x.after RLIKE '^[./?&#%]' THEN -1 ELSE 0 END"""
    return """IF(x.before RLIKE '[A-Za-z0-9=_"/-]$' OR x.after RLIKE '^[A-Za-z0-9=_"/-]', -1, IF(x.before RLIKE '(^|[ ,;:(\\n])$', 1, 0))"""


#: What a candidate's check is worth to the labeller: these have one that a chance match seldom passes.
CHECKED = ("email", "ip", "card", "phone", "iban", "ipv6", "private_key")


def candidates(df: DataFrame, text: str, p: str = "_") -> DataFrame:
    """df with a column c (all new names begin with p): an array of kind, place, validity, votes and features of each candidate."""
    own = df.withColumn(f"{p}t", text_or_empty(text)).withColumn(f"{p}digit", F.col(f"{p}t").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    both: list[Column] = []
    for k, pattern, guard in PATTERNS:
        guard = guard.replace("_t", f"{p}t").replace("_digit", f"{p}digit")
        own = own.withColumns({f"{p}f_{k}": F.when(F.expr(guard), F.regexp_extract_all(f"{p}t", F.lit(pattern), F.lit(0))).otherwise(none)})
        both.append(F.when(F.size(f"{p}f_{k}") > 0, F.split(f"{p}t", pattern, -1)).otherwise(none).alias(f"{p}g_{k}"))
    own = own.select("*", *both)
    for k, _, _ in PATTERNS:
        shaped = f"""transform(filter({_spans(f'{p}f_{k}', f'{p}g_{k}')}, x -> ({_valid(k)}) OR ({_plausible(k)})), x -> named_struct(
            'kind', '{k}', 's', x.s, 'e', x.e, 'valid', {_valid(k)}, 'gaz', {_gazetteer(k)}, 'cue', {_cue(k)}, 'side', {_side(k)},
            'size', least(9, length(x.m) DIV 3), 'digits', CAST(round(4 * length({_digits('x.m')}) / length(x.m)) AS INT),
            'kinds', least(9, length(regexp_replace(regexp_replace(x.m, '[0-9A-Za-z]+', ''), '(.)\\\\1+', '$1')))))"""
        own = own.withColumn(f"{p}s_{k}", F.when(F.size(f"{p}f_{k}") > 0, F.expr(shaped)).otherwise(F.array()))
    out = own.withColumn(f"{p}c", F.concat(*(F.col(f"{p}s_{k}") for k in KINDS)))
    return out.drop(*(f"{p}{x}_{k}" for x in "fgs" for k in KINDS), f"{p}digit")


#: Votes by candidate column, and the features of the classifier.
_CHECK = "CASE WHEN NOT x.valid THEN -1 WHEN x.kind IN ('" + "', '".join(CHECKED) + "') THEN 1 WHEN x.kind = 'secret' AND x.digits BETWEEN 1 AND 3 THEN 1 ELSE 0 END"
VOTES = ("check", "gaz", "cue", "side")
FEATURES = ("valid", "size", "digits", "kinds", "cue", "side", "gaz")


def expectation_maximisation(counts: dict[tuple, float], rounds: int = 30, weight: float = 4.0) -> tuple[float, list[dict], dict[tuple, float]]:
    """counts by votes (-1, 0 or 1 each): prior, reliabilities P(vote | class) for both classes, posterior by votes."""
    n = len(next(iter(counts)))
    start = ({1: 0.05, 0: 0.25, -1: 0.70}, {1: 0.70, 0: 0.25, -1: 0.05})
    prior, rel = 0.5, [[dict(s) for s in start] for _ in range(n)]
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for v in counts:
            a = math.log(prior) + sum(math.log(rel[j][1][v[j]]) for j in range(n))
            b = math.log(1 - prior) + sum(math.log(rel[j][0][v[j]]) for j in range(n))
            post[v] = 1 / (1 + math.exp(min(700.0, b - a)))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (sum(counts[v] * post[v] for v in counts) + weight / 2) / (total + weight)))
        for j in range(n):
            for y in (0, 1):
                mass = {x: weight * start[y][x] for x in (-1, 0, 1)}
                for v, c in counts.items():
                    mass[v[j]] += c * (post[v] if y else 1 - post[v])
                whole = sum(mass.values())
                rel[j][y] = {x: m / whole for x, m in mass.items()}
    return prior, rel, post


def train(table: list[dict]) -> dict[str, float]:
    """From counted candidates (kind, votes, features, count): log odds by 'kind|feature|value', and 'kind|prior'."""
    odds: dict[str, float] = {}
    for kind in sorted({r["kind"] for r in table}):
        own = [r for r in table if r["kind"] == kind]
        counts: dict[tuple, float] = {}
        for r in own:
            v = tuple(r[f"v_{x}"] for x in VOTES)
            counts[v] = counts.get(v, 0) + r["n"]
        _, _, post = expectation_maximisation(counts)
        yes = [r["n"] * post[tuple(r[f"v_{x}"] for x in VOTES)] for r in own]
        pos, neg = sum(yes) + 1, sum(r["n"] for r in own) - sum(yes) + 1
        odds[f"{kind}|prior"] = math.log(pos / neg)
        for f in FEATURES:
            values: dict[str, list[float]] = {}
            for r, p in zip(own, yes, strict=True):
                x = values.setdefault(str(r[f"f_{f}"]), [0.5, 0.5])
                x[0] += p
                x[1] += r["n"] - p
            for value, (p, q) in values.items():
                odds[f"{kind}|{f}|{value}"] = math.log(p / (pos + len(values) / 2 - 1)) - math.log(q / (neg + len(values) / 2 - 1))
    return odds


def find(df: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """df with base_spans and all_spans: arrays of kind, start, end (code points, end exclusive), by kind and start. The driver
    gets the counted combinations of votes and features; each has ten values at most, so their number does not grow with
    the data (a few hundred in practice)."""
    votes = {"check": _CHECK, "gaz": "x.gaz", "cue": "x.cue", "side": "x.side"}
    fields = ["'kind', x.kind", *(f"'v_{n}', {c}" for n, c in votes.items()), *(f"'f_{f}', CAST(x.{f} AS STRING)" for f in FEATURES)]
    # whole structures are exploded: single fields of an exploded expression would be computed anew for each element
    each = candidates(df.select(F.col(text).alias("text")), "text").select(F.explode(F.expr(f"transform(_c, x -> named_struct({', '.join(fields)}))")).alias("x"))
    counted = each.groupBy("x").agg(F.count("*").alias("n"))
    odds = train([r["x"].asDict() | {"n": r["n"]} for r in counted.collect()])
    kept = df.drop("base_spans", "all_spans")
    p = free_prefix(kept.columns, "pii_")
    out = candidates(kept, text, p)
    shape = "named_struct('kind', x.kind, 'start', x.s, 'end', x.e)"
    is_base = "x.valid AND x.kind IN ('" + "', '".join(BASE) + "')"
    out = out.withColumn("base_spans", F.expr(f"transform(filter({p}c, x -> {is_base}), x -> {shape})"))
    if not odds:
        return out.withColumn("all_spans", F.col("base_spans")).drop(f"{p}c", f"{p}t")
    known = "map(" + ", ".join(f"'{k}', {v:.6f}D" for k, v in sorted(odds.items())) + ")"
    score = " + ".join([f"coalesce(_odds[concat(x.kind, '|prior')], 0D)", *(f"coalesce(_odds[concat(x.kind, '|{f}|', CAST(x.{f} AS STRING))], 0D)" for f in FEATURES)])
    bound = math.log(accept / (1 - accept))
    out = out.withColumn(f"{p}more", F.expr(f"filter({p}c, x -> NOT ({is_base}))"))
    out = out.withColumn(f"{p}more", F.expr(f"CASE WHEN size({p}more) = 0 THEN {p}more ELSE filter({p}more, x -> {score.replace('_odds', known)} >= {bound:.6f}D) END"))
    out = out.withColumn(f"{p}more", F.expr(f"filter({p}more, x -> NOT exists(base_spans, b -> b.start < x.e AND x.s < b.end))"))
    out = out.withColumn(f"{p}keys", F.expr(f"filter({p}more, x -> x.kind = 'private_key')"))
    out = out.withColumn(f"{p}more", F.expr(f"filter({p}more, x -> x.kind = 'private_key' OR NOT exists({p}keys, y -> y.s < x.e AND x.s < y.e))"))
    return out.withColumn("all_spans", F.expr(f"concat(base_spans, transform({p}more, x -> {shape}))")).drop(*(p + x for x in ("c", "t", "more", "keys")))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def count_of(kind: str, spans: str = "base_spans") -> Column:
    return F.expr(f"CAST(size(filter({spans}, x -> x.kind = '{kind}')) AS BIGINT)")
