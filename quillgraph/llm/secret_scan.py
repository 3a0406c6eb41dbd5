"""Secret scans: a battery of randomness tests, in SQL functions only.

Secrets of known form (assignments, access keys, hexadecimal runs) are found by pattern. Beyond these, every whole run of
20 or more letters, digits and + / _ - is a candidate. Its encoding is inferred from its characters; under that encoding
three tests ask whether it could be uniformly random: chi-squared over the alphabet, the number of runs
above and below the alphabet's middle, and lag-1 serial correlation. Their p-values are combined by Fisher's method;
a candidate that is not random by the battery is no secret.

Short text may look random by luck. How text behaves is measured over all documents: the chance that two characters of
a candidate of small letters alone are equal. Against it, a candidate's chi-squared statistic has a non-central
distribution that moves away from the uniform one in proportion to the candidate's length, of which the lower tail counts;
and text keeps its digits together, so that changes between digits and others are few for its length, of which the upper
tail counts. The two make the p-value as text, again by Fisher's method (of letters alone, the first is all there is), and
those pass the Benjamini-Hochberg rule over all candidates of an encoding and class of length. Its threshold comes from
counts of p-values in fine bins.

No encoding is left out, but some have little to tell by: of letters alone, runs of about 100 or more are told from text;
runs of decimal digits look the same whatever they are, and are hexadecimal spans by their form already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm._table import put_back, set_aside, table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = "AKIA[A-Z0-9]{14,}"
_HEX = "[0-9a-f]{16,}"
SHORTEST = 20
_CLASS = "[A-Za-z0-9+/_-]"
_CANDIDATE = f"(?<!{_CLASS}){_CLASS}{{{SHORTEST},}}={{0,2}}"
#: The battery's level, and the false discovery rate.
ALPHA, FDR = 0.001, 0.01
#: Characters between changes from digits to others or back in text-like tokens, on average, at least.
TEXT_STRETCH = 8
#: p-values are binned by tenths of their natural logarithm, down to e^-60.
_BINS = 600
#: Matches of one text that are added up in one go.
_CHUNK = 256
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets in the order they are tried: name, pattern, characters.
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("alnum_lower", "^[a-z0-9]+$", _LOWER + _DIGITS),
    ("alnum_upper", "^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/=]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64_url", "", _UPPER + _LOWER + _DIGITS + "-_"),
]


def _by_encoding(name: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (e, _, _), v in list(zip(ENCODINGS, values, strict=True))[-2::-1]:
        out = F.when(name == e, F.lit(v)).otherwise(out)
    return out


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to a relative error of a few thousandths also far out."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.greatest(F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-300))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _added(x: Column, **fields: Column) -> Column:
    """Struct x with more fields. Each step binds what the one before computed, so nothing is written out twice."""
    out = x
    for name, value in fields.items():
        out = out.withField(name, value)
    return out


def battery(tokens: Column) -> Column:
    """Array of structs with a field token -> with encoding, n, size (of the alphabet), chi2, and p, the combined
    p-value under uniform randomness, too. Padding (=) counts as no character; null and empty arrays stay."""
    step1 = F.transform(tokens, lambda x: _added(x, body=F.regexp_replace(x["token"], "=+$", "")))

    def infer(x: Column) -> Column:
        name = F.lit(ENCODINGS[-1][0])
        for e, pattern, _ in ENCODINGS[-2::-1]:
            name = F.when(x["body"].rlike(pattern), F.lit(e)).otherwise(name)
        return _added(x, encoding=name, n=F.length(x["body"]).cast("double"))

    def count(x: Column) -> Column:
        squares = F.lit(0.0)  # of the counts of each character
        for c in _UPPER + _LOWER + _DIGITS + "+/-_":
            squares = squares + F.pow(F.length(x["body"]) - F.length(F.replace(x["body"], F.lit(c), F.lit(""))), F.lit(2.0))
        halves = F.lit(None).cast("string")  # below or above the alphabet's middle
        for e, _, a in ENCODINGS:
            halves = F.when(x["encoding"] == e, F.translate(x["body"], a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))).otherwise(halves)
        alphabet = _by_encoding(x["encoding"], [a for _, _, a in ENCODINGS])
        plain = F.translate(x["body"], _DIGITS + _UPPER + _LOWER + "+/-_", "0" * 10 + "1" * 56)
        return _added(x, size=_by_encoding(x["encoding"], [float(len(a)) for _, _, a in ENCODINGS]), squares=squares, halves=halves, alphabet=alphabet, plain=plain)

    def statistics(x: Column) -> Column:
        n, size = x["n"], x["size"]
        average = (size + 1) / 2
        codes = F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - average)
        return _added(
            x,
            chi2=x["squares"] * size / F.greatest(n, F.lit(1.0)) - n,
            ones=F.length(F.replace(x["halves"], F.lit("0"), F.lit(""))).cast("double"),
            changes=(n * 2 - F.length(F.replace(x["halves"], F.lit("01"), F.lit(""))) - F.length(F.replace(x["halves"], F.lit("10"), F.lit("")))) / 2,
            mixed=(n * 2 - F.length(F.replace(x["plain"], F.lit("01"), F.lit(""))) - F.length(F.replace(x["plain"], F.lit("10"), F.lit("")))) / 2,
            codes=codes,
        )

    def tests(x: Column) -> Column:
        n, size, df = x["n"], x["size"], x["size"] - 1
        # Wilson and Hilferty's normal form of chi-squared
        z = (F.pow(F.greatest(x["chi2"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 2 * x["ones"] * (n - x["ones"]) / n + 1
        runs = F.abs(x["changes"] + 1 - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        ahead = F.zip_with(F.slice(x["codes"], F.lit(1), F.size(x["codes"]) - 1), F.slice(x["codes"], F.lit(2), F.size(x["codes"]) - 1), lambda a, b: a * b)
        serial = F.abs(F.aggregate(ahead, F.lit(0.0), lambda s, v: s + v)) / ((size * size - 1) / 12 * F.sqrt(n - 1))
        return _added(x, z=F.array(z, runs, serial))

    def combine(x: Column) -> Column:
        clamp = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)))
        return _added(x, fisher=-2 * (clamp(_tail(x["z"][0])) + clamp(2 * _tail(x["z"][1])) + clamp(2 * _tail(x["z"][2]))))

    def upper(x: Column) -> Column:  # chi-squared of six degrees
        f = x["fisher"]
        return _added(x, p=F.exp(-f / 2) * (1 + f / 2 + f * f / 8))

    out = step1
    for step in (infer, count, statistics, tests, combine, upper):
        out = F.transform(out, step)
    return out


def _length_class(n: Column) -> Column:
    """Doubling classes of length."""
    return F.floor(F.log2(F.greatest(n, F.lit(1.0)))).cast("int")


def _text_bin(test: Column, kappa: float) -> Column:
    """Bin of the p-value as text: ten times the negative logarithm, rounded down."""
    # a hexadecimal or decimal candidate is no word; its text-like rival is a run of decimal digits
    rival = F.when(test["encoding"].isin("hex", "hex_upper"), F.lit(max(kappa, 0.1))).otherwise(F.lit(kappa))
    away = F.greatest(test["size"] * rival - 1, F.lit(0.05)) * test["n"]
    df = test["size"] - 1
    z = (test["chi2"] - df - away) / F.sqrt(2 * (df + 2 * away))
    changes = 2 * (F.sqrt(test["mixed"] + 0.375) - F.sqrt(test["n"] / TEXT_STRETCH))  # of a Poisson count, about normal
    first = -F.log(F.greatest(_tail(-z), F.lit(1e-30)))
    half = first - F.log(F.greatest(_tail(changes), F.lit(1e-30)))
    return F.least(F.floor(10 * F.when(test["encoding"].isin("lower", "upper", "letters"), first).otherwise(half - F.log1p(half))), F.lit(_BINS)).cast("int")


def thresholds(docs: DataFrame) -> tuple[float, dict[tuple[str, int], int]]:
    """The text's chance of equal characters, and the smallest bin that passes for each (encoding, length class).

    Counts over all documents; what comes to the driver is one row for each encoding, class and bin in use.
    """
    of = docs.where("text is not null")
    words = of.select(F.explode(F.regexp_extract_all("text", F.lit(f"[a-z]{{{SHORTEST},}}"), F.lit(0))).alias("token"))
    squares = F.lit(0.0)
    for c in _LOWER:
        squares = squares + F.pow(F.length("token") - F.length(F.replace(F.col("token"), F.lit(c), F.lit(""))), F.lit(2.0))
    n = F.length("token").cast("double")
    pairs = words.agg(F.sum(squares - n).alias("equal"), F.sum(n * (n - 1)).alias("all")).first()
    kappa = round(pairs["equal"] / pairs["all"], 4) if pairs["all"] else 0.0667
    found = F.transform(F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0)), lambda t: F.struct(t.alias("token")))
    tested = of.where(F.col("text").rlike(_CANDIDATE)).select(F.explode(battery(found)).alias("t"))
    rows = tested.select(F.col("t.encoding").alias("encoding"), _length_class(F.col("t.n")).alias("class"), _text_bin(F.col("t"), kappa).alias("bin")).groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    cut: dict[tuple[str, int], int] = {}
    for key in {(r.encoding, r["class"]) for r in rows}:
        counts = {r.bin: r.n for r in rows if (r.encoding, r["class"]) == key}
        total, seen = sum(counts.values()), 0
        for b in sorted(counts, reverse=True):  # the largest number of rejections whose threshold holds
            seen += counts[b]
            if math.exp(-b / 10) <= FDR * seen / total:
                cut[key] = b
    return kappa, cut


def _matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (kind, start, end, token) of leftmost matches: lengths of what lies between them, added up.

    An aggregate copies what it gathered at every step, so that they are added up in chunks of ``_CHUNK`` and these
    put together: m matches cost m * _CHUNK + m * m / _CHUNK rather than m * m.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,token:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("token")))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + x["m"]).alias("end"), x["token"].alias("token"))
        good = keep(x["token"]) if keep else F.lit(True)
        return F.struct((begin + x["m"]).alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def join(acc: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["spans"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["token"].alias("token")))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    def in_chunks(every: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _CHUNK).cast("int"))
        chunks = F.transform(numbers, lambda k: F.aggregate(F.slice(every, k * _CHUNK + 1, F.lit(_CHUNK)), start, step))
        return F.aggregate(chunks, start, join, lambda acc: acc["spans"])

    # the array of one binds the lengths, so that they are found once rather than once a chunk
    return F.when(text.rlike(pattern), F.transform(F.array(lengths), in_chunks)[0]).otherwise(none)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with spans: array of (kind, start, end) in code points, by start, then kind as listed.

    Spans of the battery (kind random) that lie within one of a known form are not repeated. Null and empty texts have
    none; repeated rows each have theirs, and count each in the thresholds; a column named spans is replaced, all others
    stay. An empty table gives an empty one. Long texts are read whole.
    """
    columns, docs = docs.columns, set_aside(docs)
    keep = docs.columns
    kappa, cut = thresholds(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda token: F.length(F.regexp_extract(token, _ASSIGN, 1)) >= 12
    base = F.concat(_matches(text, _ASSIGN, "assign", value), _matches(text, _ACCESS, "access"), _matches(text, _HEX, "hex"))

    def passes(t: Column) -> Column:
        limit = F.lit(None).cast("int")
        for (e, c), b in sorted(cut.items()):
            limit = F.when((t["encoding"] == e) & (_length_class(t["n"]) == c), F.lit(b)).otherwise(limit)
        return (t["p"] >= ALPHA) & F.coalesce(_text_bin(t, kappa) >= limit, F.lit(False))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,token:string>>")
    out = docs.select(*keep, base.alias("_base"), (_matches(text, _CANDIDATE, "random") if cut else none).alias("_candidates"))
    random = F.transform(F.filter(battery(F.col("_candidates")), passes), lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token")))
    out = out.select(*keep, "_base", F.when(F.size("_candidates") > 0, random).otherwise(none).alias("_random"))
    fresh = F.filter("_random", lambda r: ~F.exists("_base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    every = F.transform(F.concat("_base", fresh), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = out.select(*keep, F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return put_back(out, columns, ("spans",))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(written(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
