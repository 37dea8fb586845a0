"""Secret scans in DataFrame functions only: fixed forms, and a randomness battery over long tokens.

Fixed forms (assign, access, hex) are leftmost, non-overlapping matches of one expression each. Their
places come from the text between matches: `split` gives the gaps, `regexp_extract_all` the matches, and
the running sums of both lengths, taken in two levels, are the starts in code points.

Randomness: maximal runs of CANDIDATE are tokens. The encoding of a token is the smallest alphabet it
fits. On the alphabet's indexes three statistics are taken: chi-squared against uniform use, the runs
above and below the middle of the alphabet, and the lag-1 serial correlation. A token is discovered if

* its p-value under its encoding's null passes the false-discovery control, and
* none of the three tests rejects uniform, independent symbols at level BATTERY_ALPHA.

The null is wording: the p-value is the lower tail of the number of equal pairs of symbols, of which
chi-squared is a linear function (COINCIDENCE). Four encodings have their own, as uniform symbols of small
alphabets repeat as often as wording does:

* hex: letters as wording has them, of which HEX_LETTERS are a to f; p is the chance that all letters are.
  Digits say nothing, so numbers with few letters aren't found.
* decimal: formatted numbers, with DECIMAL_ZERO of their digits zero and the others equally frequent; the
  lower tail of the number of equal pairs. Only long ones can be told apart.
* base32 and base36: wording, and words with numbers, which change between letters and digits at a rate of
  CHANGES; Fisher's combination of both p-values, taken as independent, the second as the Chernoff
  bound of a Poisson tail.

False-discovery control is Benjamini-Hochberg at level FDR over the tokens of the corpus that overlap no
fixed form; a token that the three tests reject counts with a p-value of 1. It's weighted by
length: longer tokens, which the test can tell apart, get more of the level, in proportion to 2 + log2(n /
20) by class, so that a few very long ones don't take it from the rest. p-values are
rounded up to a grid, so the step-up runs over a histogram of bounded size (length class x grid), which
is all that reaches the driver; it's exact for the rounded values, and rounding up is conservative.
A discovered token is added (kind "random") where it doesn't overlap a fixed form.

Defined results: null texts count as empty and have no spans; repeated rows repeat; no rows give no
rows; other columns are ignored. The level depends on all rows of the table, and on nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import table, texts

KINDS = ("assign", "access", "hex", "random")
#: kind -> (expression for Spark, group whose length counts, least length of it)
FORMS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs can't be entered later with more left, so the least length may stand in the expression.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Rates at which two, and three, symbols of wording are equal (English letters).
COINCIDENCE = (0.0655, 0.0055)
#: Share of a to f in English letters; zeros of formatted numbers; changes of class for each symbol of words with numbers.
HEX_LETTERS, DECIMAL_ZERO, CHANGES = 0.317, 0.3, 0.05
BATTERY_ALPHA = 1e-3
FDR = 0.01
#: p-values on a grid of 1/GRID decades, down to 10 ** -DECADES.
GRID, DECADES = 16, 30
#: Length classes: 20 * sqrt(2) ** i, the last one open.
CLASSES = 16
CHUNK = 256
MARK = "[SECRET]"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding, form of the token without its padding, alphabet, whether case is folded
ENCODINGS = [
    ("decimal", r"^[0-9]+$", _DIGITS, False),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", True),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567", False),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, True),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", False),
    ("base64url", r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", False),
    ("any", r"", _UPPER + _LOWER + _DIGITS + "+/-_=", False),
]


def _starts(lengths: str) -> str:
    """SQL: the running sums before each element of an array, in two levels so that long arrays stay cheap."""
    upto = "aggregate({0}, array(0L), (a, v) -> concat(a, array(element_at(a, -1) + v)))"
    blocks = f"transform(sequence(0, greatest(size({lengths}) - 1, 0) div {CHUNK}), k -> slice({lengths}, k * {CHUNK} + 1, {CHUNK}))"
    sums = f"transform({blocks}, b -> aggregate(b, 0L, (a, v) -> a + v))"
    return f"flatten(zip_with({blocks}, slice({upto.format(sums)}, 1, greatest(size({lengths}) - 1, 0) div {CHUNK} + 1), (b, o) -> transform(slice({upto.format('b')}, 1, size(b)), s -> s + o)))"


def _quoted(expression: str) -> str:
    return "r'" + expression.replace("'", r"\x27") + "'"


def _found(df: DataFrame, kind: str, expression: str) -> DataFrame:
    """df with the columns {kind}_m, the matches, and {kind}_s, their starts; empty arrays without a match."""
    e = _quoted(expression)
    df = df.withColumn(f"{kind}_has", F.expr(f"text rlike {e}"))
    df = df.withColumn(f"{kind}_m", F.expr(f"if({kind}_has, regexp_extract_all(text, {e}, 0), array())"))
    # the length of a gap and the match after it; starts are the sums before, plus the gap itself
    df = df.withColumn(f"{kind}_g", F.expr(f"if({kind}_has, transform(slice(split(text, {e}, -1), 1, size({kind}_m)), g -> cast(length(g) as bigint)), cast(array() as array<bigint>))"))
    df = df.withColumn(f"{kind}_l", F.expr(f"zip_with({kind}_g, {kind}_m, (g, m) -> g + length(m))"))
    return df.withColumn(f"{kind}_s", F.expr(f"if({kind}_has, zip_with({_starts(f'{kind}_l')}, {kind}_g, (s, g) -> s + g), cast(array() as array<bigint>))")).drop(f"{kind}_g", f"{kind}_l")


def _fixed(df: DataFrame) -> DataFrame:
    """Adds base: array<struct<start, rank, kind, end>> sorted by start, then kind as listed."""
    parts = []
    for rank, (kind, (expression, group, least)) in enumerate(FORMS.items()):
        df = _found(df, kind, expression)
        spans = f"zip_with({kind}_s, {kind}_m, (s, m) -> struct(s as start, {rank} as rank, '{kind}' as kind, s + length(m) as end))"
        if group:
            df = df.withColumn(f"{kind}_v", F.expr(f"if({kind}_has, regexp_extract_all(text, {_quoted(expression)}, {group}), array())"))
            spans = f"filter({spans}, (x, i) -> length({kind}_v[i]) >= {least})"
        df = df.withColumn(f"{kind}_x", F.expr(spans))
        parts.append(f"{kind}_x")
    df = df.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    return df.drop(*(f"{k}_{x}" for k in FORMS for x in ("m", "s", "has", "v")))


def _normal_tail(z: str) -> str:
    """SQL: the upper tail of the standard normal distribution (Zelen and Severo), for any sign."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    upper = f"(exp(-0.5D * {z} * {z}) * 0.3989422804014327D * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    return f"(if({z} >= 0, {upper}, 1 - {upper}))"


def _z_pairs(q2: float, q3: float) -> str:
    """SQL: by how many deviations equal pairs differ from symbols of which two, three are equal at these rates."""
    return f"(x.pairs + 0.5D - x.all * {q2!r}D) / sqrt(x.all * {q2 * (1 - q2)!r}D + x.n * (x.n - 1) * (x.n - 2) * {q3 - q2 * q2!r}D)"


def _place(p: str) -> str:
    """SQL: a p-value's place on the grid, 0 for 1."""
    return f"cast(least({GRID * DECADES}, greatest(0, floor(-{GRID} * log10(greatest(1e-300D, {p}))))) as int)"


def _battery(tokens: str) -> str:
    """SQL: array of tokens -> array<struct<n, class, grid, passes, own>>.

    grid is the place of wording's p-value, own of the encoding's; own is 0 where the tests reject.
    """
    cases = " ".join(f"when t rlike {_quoted(form)} then named_struct('e', '{name}', 'a', '{alphabet}', 's', {'lower(t)' if fold else 't'})" for name, form, alphabet, fold in ENCODINGS[:-1])
    last = ENCODINGS[-1]
    x = f"transform({tokens}, t0 -> rtrim('=', t0))"
    x = f"transform({x}, t -> case {cases} else named_struct('e', '{last[0]}', 'a', '{last[2]}', 's', t) end)"
    half = "cast(length(x.a) div 2 as int)"
    x = f"""transform({x}, x -> named_struct('e', x.e, 'n', cast(length(x.s) as double), 'k', cast(length(x.a) as double), 's', x.s,
        'kinds', translate(lower(x.s), '{_LOWER}{_DIGITS}', concat(repeat('a', 26), repeat('0', 10))),
        'bits', translate(x.s, x.a, concat(repeat('0', {half}), repeat('1', length(x.a) - {half}))),
        'at', transform(filter(split(x.s, ''), c -> c != ''), c -> cast(instr(x.a, c) - 1 as double))))"""
    x = f"""transform({x}, x -> named_struct('e', x.e, 'n', x.n, 'k', x.k, 'at', x.at,
        'letters', cast(length(replace(x.kinds, '0', '')) as double),
        'changes', (2 * length(x.kinds) - length(replace(x.kinds, '0a', '')) - length(replace(x.kinds, 'a0', ''))) / 2D,
        'squares', aggregate(array_distinct(filter(split(x.s, ''), c -> c != '')), 0D, (a, c) -> a + power(length(x.s) - length(replace(x.s, c, '')), 2)),
        'ones', cast(length(replace(x.bits, '0', '')) as double),
        'runs', 1D + (length(x.bits) - length(replace(x.bits, '01', ''))) / 2 + (length(x.bits) - length(replace(x.bits, '10', ''))) / 2,
        'mean', aggregate(x.at, 0D, (a, v) -> a + v) / x.n))"""
    x = f"""transform({x}, x -> named_struct('e', x.e, 'n', x.n, 'k', x.k, 'letters', x.letters, 'changes', x.changes,
        'pairs', (x.squares - x.n) / 2, 'all', x.n * (x.n - 1) / 2,
        'chi', x.k / x.n * x.squares - x.n,
        'runs', x.runs, 'both', 2 * x.ones * (x.n - x.ones),
        'var', aggregate(x.at, 0D, (a, v) -> a + (v - x.mean) * (v - x.mean)),
        'cov', aggregate(zip_with(slice(x.at, 1, size(x.at) - 1), slice(x.at, 2, size(x.at) - 1), (u, v) -> (u - x.mean) * (v - x.mean)), 0D, (a, v) -> a + v)))"""
    rest = (1 - DECIMAL_ZERO) / 9
    x = f"""transform({x}, x -> named_struct('e', x.e, 'n', x.n, 'letters', x.letters, 'changes', x.changes, 'expected', x.n * {CHANGES}D,
        'z_text', {_z_pairs(*COINCIDENCE)},
        'z_decimal', {_z_pairs(DECIMAL_ZERO**2 + 9 * rest**2, DECIMAL_ZERO**3 + 9 * rest**3)},
        'z_chi', (power(x.chi / (x.k - 1), 1D / 3) - (1 - 2 / (9 * (x.k - 1)))) / sqrt(2 / (9 * (x.k - 1))),
        'z_runs', if(x.both > x.n, abs(x.runs - 1 - x.both / x.n) / sqrt(x.both * (x.both - x.n) / (x.n * x.n * (x.n - 1))), 99D),
        'z_serial', if(x.var > 0, abs(x.cov / x.var) * sqrt(x.n), 99D)))"""
    text = _normal_tail("(-x.z_text)")
    changes = "if(x.changes > x.expected, exp(-(x.changes * ln(x.changes / x.expected) - x.changes + x.expected)), 1D)"
    both = f"greatest(1e-300D, {text} * {changes})"
    own = f"case x.e when 'hex' then power({HEX_LETTERS}D, x.letters) when 'decimal' then {_normal_tail('(-x.z_decimal)')} when 'base32' then {both} * (1 - ln({both})) when 'base36' then {both} * (1 - ln({both})) else {text} end"
    x = f"""transform({x}, x -> if(x.n < 20, named_struct('n', x.n, 'class', 0, 'grid', 0, 'passes', false, 'own', 0), named_struct('n', x.n,
        'class', cast(least({CLASSES - 1}, greatest(0, floor(2 * log2(x.n / 20)))) as int),
        'grid', {_place(text)},
        'passes', {_normal_tail('x.z_chi')} >= {BATTERY_ALPHA}D and 2 * {_normal_tail('x.z_runs')} >= {BATTERY_ALPHA}D and 2 * {_normal_tail('x.z_serial')} >= {BATTERY_ALPHA}D,
        'own', {_place(own)})))"""
    return f"transform({x}, x -> named_struct('n', x.n, 'class', x.class, 'grid', x.grid, 'passes', x.passes, 'own', if(x.passes, x.own, 0)))"


def _tested(df: DataFrame) -> DataFrame:
    """Adds random_m, random_s and tests for the tokens of each text."""
    return _found(df, "random", CANDIDATE).withColumn("tests", F.expr(f"if(random_has, {_battery('random_m')}, cast(array() as array<struct<n:double,class:int,grid:int,passes:boolean,own:int>>))"))


#: SQL: whether a span overlaps no fixed form.
FREE = "not exists(base, b -> b.start < {end} and {start} < b.end)"


def cutoffs(docs: DataFrame) -> list[int]:
    """For each length class the least grid place that is discovered (GRID * DECADES + 1: none).

    What is collected is the histogram, CLASSES x (GRID * DECADES + 1) rows at most.
    """
    found = _tested(_fixed(texts(docs).where(F.expr(f"text rlike {_quoted(CANDIDATE)}"))))
    free = f"filter(tests, (x, i) -> {FREE.format(start='random_s[i]', end='random_s[i] + length(random_m[i])')})"
    counts = found.select(F.explode(F.expr(free)).alias("x")).where("x.n >= 20").groupBy("x.class", "x.own").agg(F.count("*").alias("c")).collect()
    return step_up([(r["class"], r["own"], r["c"]) for r in counts])


def step_up(counts: list[tuple[int, int, int]]) -> list[int]:
    """Weighted Benjamini-Hochberg over (class, grid, tokens) rows."""
    none = GRID * DECADES + 1
    total = sum(c for *_, c in counts)
    if not total:
        return [none] * CLASSES
    mean = sum((4 + k) * c for k, _, c in counts) / total
    weight = [(4 + k) / mean for k in range(CLASSES)]
    ranked = sorted((10 ** (-g / GRID) / weight[k], c) for k, g, c in counts)
    upto, level = 0, -1.0
    for p, c in ranked:
        upto += c
        if p <= FDR * upto / total:
            level = p
    # ties at the level are counted with the last of them, so the loop above ends on their sum
    return [none if level <= 0 else min(none, max(0, math.ceil(-GRID * math.log10(min(1.0, level * weight[k])) - 1e-9))) for k in range(CLASSES)]


def _random(df: DataFrame, least: list[int]) -> DataFrame:
    """Adds more: spans of discovered tokens that overlap nothing in base."""
    levels = f"array({', '.join(map(str, least))})"
    df = _tested(df)
    spans = f"zip_with(random_s, random_m, (s, m) -> struct(s as start, {KINDS.index('random')} as rank, 'random' as kind, s + length(m) as end))"
    spans = f"filter({spans}, (x, i) -> tests[i].passes and tests[i].own >= {levels}[tests[i].class] and {FREE.format(start='x.start', end='x.end')})"
    return df.withColumn("more", F.expr(f"if(random_has, {spans}, cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>))")).drop("random_m", "random_s", "random_has", "tests")


def _said(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, base and spans, array<struct<start, rank, kind, end>> each."""
    found = _random(_fixed(texts(docs)), cutoffs(docs))
    return found.select("doc_id", "base", F.expr("array_sort(concat(base, more))").alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text, n_random."""
    found = scan(docs)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"), counts[3])


def redact(docs: DataFrame) -> DataFrame:
    """docs with MARK in place of every span in text, kind after kind, and n_chars to match; other columns stay.

    Each kind is replaced between the gaps around its matches, in one pass over the text.
    """
    names = docs.columns
    least = cutoffs(docs)
    out = docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(names) if c != "text"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("text").isNull().alias("was_null"))

    def replaced(df: DataFrame, expression: str, keep: str) -> DataFrame:
        e = _quoted(expression)
        df = df.withColumn("parts", F.expr(f"if(text rlike {e}, split(text, {e}, -1), array(text))"))
        df = df.withColumn("hits", F.expr(f"if(size(parts) > 1, regexp_extract_all(text, {e}, 0), array())"))
        return df.withColumn("text", F.expr(f"if(size(parts) > 1, concat(array_join(flatten(zip_with(slice(parts, 1, size(hits)), transform(hits, (m, i) -> if({keep}, '{MARK}', m)), (g, m) -> array(g, m))), ''), element_at(parts, -1)), text)"))

    for expression, group, size in FORMS.values():
        if group:
            out = out.withColumn("values", F.expr(f"if(text rlike {_quoted(expression)}, regexp_extract_all(text, {_quoted(expression)}, {group}), array())"))
        out = replaced(out, expression, f"length(values[i]) >= {size}" if group else "true")
    levels = f"array({', '.join(map(str, least))})"
    out = _tested(out)
    out = replaced(out, CANDIDATE, f"tests[i].passes and tests[i].own >= {levels}[tests[i].class]")
    out = out.withColumn("text", F.when(~F.col("was_null"), F.col("text")))
    kept = [F.col("text").alias(c) if c == "text" else F.col(f"own_{i}").alias(c) for i, c in enumerate(names)]
    out = out.select(*kept)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


QUERIES = {"op10_secret_scan": lambda spark, sf_dir: report(table(spark, sf_dir, "documents"))}
ORACLE_SQL: dict[str, str] = {}
