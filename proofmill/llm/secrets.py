"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

A token of a known alphabet is tested on three counts: its symbols are spread more evenly than ordinary strings
have them (chi-squared), its highs and lows alternate like chance (runs), and neighbours are unrelated (serial
correlation). The normal scores of the three make one weighted sum, whose upper tail is the token's p-value; a token
that looks patterned on the last two counts is none. The p-values of all tokens of the corpus go through
Benjamini-Hochberg control, apart for each class of length, as short tokens carry less evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import scratch

#: The kinds in their order, with what a match must be.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets in the order in which a token's is inferred.
ALPHABETS = {
    "digits": "0123456789",
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum_lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alnum_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Ordinary strings of each alphabet by class of length, as fitted to names, paths and numbers of program sources: how
#: far they are from even use of it (alphabet size times sum of squared shares, less 1), and the spread of chi-squared
#: in units of what that alone gives. Of ordinary tokens at most 5 % get p <= 0.05, and so down to 0.0005.
ORDINARY = {
    "digits": ((1.0, 1.3), (0.6, 1.0), (0.5, 0.8), (0.5, 0.8)),
    "hex_lower": ((1.4, 0.8), (1.4, 0.8), (1.4, 0.8), (1.2, 0.8)),
    "hex_upper": ((1.4, 0.8), (1.4, 0.8), (1.3, 0.8), (1.2, 0.8)),
    "lower": ((1.4, 1.5), (0.6, 0.8), (0.6, 0.8), (0.6, 0.8)),
    "upper": ((1.4, 1.5), (0.6, 0.8), (0.6, 0.8), (0.6, 0.8)),
    "base32": ((0.9, 0.8), (0.9, 0.8), (0.9, 0.8), (1.0, 0.8)),
    "alnum_lower": ((1.2, 0.9), (1.1, 0.8), (1.1, 0.8), (1.0, 0.8)),
    "alnum_upper": ((1.1, 0.9), (1.1, 0.8), (1.1, 0.8), (1.1, 0.8)),
    "base64": ((1.6, 0.9), (1.5, 0.9), (1.2, 0.8), (1.4, 0.8)),
}
#: Weights of evenness, runs and serial correlation: ordinary strings differ from random ones in the first most of all.
WEIGHTS = (1.0, 0.1, 0.1)
#: The exponential polynomial of the complementary error function, to 1.2e-7 of its value, in any tail.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: A token that runs or serial correlation call patterned at this level is no candidate.
REJECT, FALSE_SHARE, STEPS, MOST_STEPS = 0.01, 0.05, 20, 400
LENGTHS = (28, 40, 64)
_SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def _upper(z: Column) -> Column:
    """The upper tail of the normal distribution."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    power = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        power = power * t + c
    tail = t * F.exp(power - x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _score(p: Column) -> Column:
    """The normal score of a p-value, by Tukey's lambda."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return (F.pow(p, F.lit(0.1349)) - F.pow(1 - p, F.lit(0.1349))) / 0.1975


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once: inside a lambda an expression would be evaluated again at each use."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def chunked(values: Column) -> Column:
    """A non-empty array as an array of about as many parts as a part has elements."""
    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.size(values) - 1, w), lambda at: F.slice(values, at + 1, w)))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of a non-empty array what ``combine`` makes of ``zero`` and all elements before it; ``combine`` is associative.

    Appending to an array copies it, so parts are gone through apart, each from what the parts before it give: the work grows with
    the size to the power of 1.5.
    """

    def scan(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])

    def of(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, combine))
        return let(scan(totals, zero), lambda starts: F.flatten(F.zip_with(parts, starts, scan)))

    return let(chunked(values), of)


#: Stands about matches while a text is cut. No pattern matches it; one in a text is taken for its neighbour.
_CUT, _ALIKE = "\ue000", "\ue001"


def placed(text: Column, pattern: str, least_of: tuple[int, int] | None = None) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches: code points, end exclusive.

    Matches are marked by one replacement and the text is split at the marks, so it is read three times whatever their number;
    the lengths of what lies before a match add up to its place. ``least_of`` (group, n): matches whose group is shorter are left
    out after they were consumed.
    """
    step = 3 if least_of else 2
    marks = f"{_CUT}$0{_CUT}" + (f"${least_of[0]}{_CUT}" if least_of else "")
    own = F.when(F.contains(text, F.lit(_CUT)), F.translate(text, _CUT, _ALIKE)).otherwise(text)
    pieces = F.split(F.regexp_replace(own, pattern, marks), _CUT, -1)
    size = lambda x: F.length(x).cast("bigint")

    def match(p: Column, i: Column) -> Column:
        return F.struct(size(F.get(p, i - 1)).alias("gap"), size(F.get(p, i)).alias("size"), F.get(p, i).alias("value"), (F.length(F.get(p, i + 1)) if least_of else F.lit(0)).alias("part"))

    def spans(m: Column) -> Column:
        before = running(F.transform(m, lambda x: x["gap"] + x["size"]), F.lit(0).cast("bigint"), lambda x, y: x + y)
        kept = F.zip_with(m, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"), x["value"].alias("value"), x["part"].alias("part")))
        kept = F.filter(kept, lambda x: x["part"] >= least_of[1]) if least_of else kept
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))

    found = let(pieces, lambda p: let(F.transform(F.sequence(F.lit(1), F.size(p) - step, F.lit(step)), lambda i: match(p, i)), spans))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def _as_spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["stop"])).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start, then kind as listed."""
    found = ((ASSIGN, (2, ASSIGN_LEAST), "assign"), (ACCESS, None, "access"), (HEX, None, "hex"))
    return F.array_sort(F.concat(*(_as_spans(placed(text, pattern, least), kind) for pattern, least, kind in found)))


def _let(tokens: Column, make: Callable[[Column], dict[str, Column]]) -> Column:
    """Add named fields to each struct of an array."""

    def add(x: Column) -> Column:
        for name, value in make(x).items():
            x = x.withField(name, value)
        return x

    return F.transform(tokens, add)


def tested(tokens: Column) -> Column:
    """array<struct<start, stop, length_class, step>> of the tokens that keep a p-value below 1.

    ``step`` is floor(-20 log10 p), 400 at most: p-values are rounded up to a grid, which only makes the control
    of false discoveries stricter.
    """
    def infer(x: Column) -> Column:
        out = F.lit(ALPHABETS["base64"])
        for letters in reversed(list(ALPHABETS.values())[:-1]):
            out = F.when(F.translate(x["value"], letters, "") == "", F.lit(letters)).otherwise(out)
        return out

    named = _let(tokens, lambda x: {"alphabet": infer(x), "n": F.length(x["value"]).cast("double")})
    named = _let(named, lambda x: {"k": F.length(x["alphabet"]).cast("double")})
    counts = lambda x: F.transform(F.sequence(F.lit(1), F.length(x["alphabet"])), lambda i: F.length(x["value"]) - F.length(F.replace(x["value"], F.substring(x["alphabet"], i, F.lit(1)), F.lit(""))))
    codes = lambda x: F.transform(F.split(x["value"], ""), lambda c: (F.position(c, x["alphabet"]) - 1).cast("double"))

    def walk(x: Column) -> Column:
        zero = F.struct(*(F.lit(v).cast("double").alias(c) for c, v in (("last", -1), ("runs", 0), ("high", 0), ("s", 0), ("q", 0), ("c", 0), ("first", -1))))

        def step(a: Column, v: Column) -> Column:
            high, was = 2 * v >= x["k"], 2 * a["last"] >= x["k"]
            return F.struct(
                v.alias("last"),
                (a["runs"] + F.when((a["last"] < 0) | (high != was), 1.0).otherwise(0.0)).alias("runs"),
                (a["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"),
                (a["s"] + v).alias("s"),
                (a["q"] + v * v).alias("q"),
                (a["c"] + F.when(a["last"] < 0, 0.0).otherwise(a["last"] * v)).alias("c"),
                F.when(a["first"] < 0, v).otherwise(a["first"]).alias("first"),
            )

        return F.aggregate(codes(x), zero, step)

    sums = _let(named, lambda x: {"squares": F.aggregate(counts(x), F.lit(0.0), lambda a, c: a + c.cast("double") * c), "w": walk(x)})

    class_of = lambda n: sum((F.when(n >= at, 1).otherwise(0) for at in LENGTHS), F.lit(0))

    def ordinary(x: Column, which: int) -> Column:
        out = F.lit(None).cast("double")
        for name, letters in ALPHABETS.items():
            out = F.when(x["alphabet"] == letters, F.get(F.array(*(F.lit(fit[which]) for fit in ORDINARY[name])), class_of(x["n"]))).otherwise(out)
        return out

    sums = _let(sums, lambda x: {"uneven": ordinary(x, 0), "spread": ordinary(x, 1)})

    def pvalues(x: Column) -> dict[str, Column]:
        n, k, w = x["n"], x["k"], x["w"]
        chi = k / n * x["squares"] - n
        even = (k - 1 + n * x["uneven"] - chi) / (x["spread"] * F.sqrt(2 * (k - 1) + 4 * n * x["uneven"]))
        low = n - w["high"]
        mean = 1 + 2 * w["high"] * low / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(variance > 0, 2 * _upper(F.abs(w["runs"] - mean) / F.sqrt(variance))).otherwise(0.0)
        spread = n * w["q"] - w["s"] * w["s"]
        serial = F.when(spread > 0, (n * (w["c"] + w["last"] * w["first"]) - w["s"] * w["s"]) / spread).otherwise(1.0)
        return {"even": even, "runs": runs, "related": 2 * _upper(F.abs(serial + 1 / (n - 1)) * F.sqrt(n))}

    def combined(x: Column) -> dict[str, Column]:
        z = (WEIGHTS[0] * x["even"] + WEIGHTS[1] * _score(x["runs"]) + WEIGHTS[2] * _score(x["related"])) / sum(w * w for w in WEIGHTS) ** 0.5
        return {"p": F.when((x["runs"] >= REJECT) & (x["related"] >= REJECT), F.greatest(_upper(z), F.lit(1e-20))).otherwise(1.0)}

    judged = _let(_let(sums, pvalues), combined)
    step = lambda p: F.least(F.floor(-STEPS * F.log10(p)), F.lit(MOST_STEPS)).cast("int")
    return F.transform(judged, lambda x: F.struct(x["start"], x["stop"], class_of(x["n"]).alias("length_class"), step(x["p"]).alias("step")))


def least_steps(scanned: DataFrame) -> dict[int, int]:
    """For each class of length the step from which tokens are discoveries; at most four rows reach the driver."""
    steps = scanned.select(F.explode("tokens").alias("t")).groupBy("t.length_class", "t.step").agg(F.count("*").alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("step"))
    at_least, every = F.sum("n").over(down), F.sum("n").over(Window.partitionBy("length_class"))
    passing = steps.withColumns({"found": at_least, "m": every}).where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE_SHARE * F.col("found") / F.col("m"))
    return {r["length_class"]: r["least"] for r in passing.groupBy("length_class").agg(F.min("step").alias("least")).collect()}


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of each row of ``docs`` with ``base`` and ``spans``: arrays of (start, rank, kind, stop).

    ``base`` has the fixed kinds, ``spans`` also random tokens that meet no base span. Null text is empty and has
    none; texts are scanned whole; equal texts get equal spans; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(*keep, base_spans(text).alias("base"), tested(placed(text, TOKEN)).alias("tokens"))
    scanned = scratch.materialize(scanned, "spans")
    least = least_steps(scanned)
    from_step = F.create_map(*(F.lit(v) for pair in least.items() for v in pair)) if least else None

    def found(t: Column) -> Column:
        return (t["step"] >= F.coalesce(F.element_at(from_step, t["length_class"]), F.lit(MOST_STEPS + 1))) if least else F.lit(False)

    extra = _as_spans(clear_of(F.filter("tokens", found), F.col("base")), "random")
    return scanned.select(*keep, "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def clear_of(tokens: Column, base: Column) -> Column:
    """The tokens, which are in order and apart, that meet no base span; a part of them is held against the spans about it only."""
    meets = lambda t, b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])

    def part(c: Column) -> Column:
        reach = F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.element_at(c, -1)["stop"].alias("stop"))
        about = let(reach, lambda r: F.filter(base, lambda b: meets(r, b)))
        return let(about, lambda near: F.filter(c, lambda t: ~F.exists(near, lambda b: meets(t, b))))

    return F.when(F.size(tokens) > 0, let(chunked(tokens), lambda parts: F.flatten(F.transform(parts, part)))).otherwise(tokens)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs`` with doc_id and text."""
    count = lambda kind: F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``.

    What stays before a span begins where all spans before it have ended. Parts of the text are cut out first and the pieces from
    them, so no piece is looked for from the start of a long text.
    """
    ends = running(F.transform(spans, lambda s: s["stop"]), F.lit(0).cast("bigint"), lambda x, y: F.greatest(x, y))
    pieces = F.zip_with(spans, ends, lambda s, at: F.struct(at.alias("start"), s["start"].alias("stop")))
    fresh = F.filter(pieces, lambda p: p["stop"] >= p["start"])
    cut = lambda whole, start, stop: F.substring(whole, (start + 1).cast("int"), (stop - start).cast("int"))

    def part(c: Column) -> Column:
        first = F.get(c, F.lit(0))["start"]
        return let(cut(text, first, F.element_at(c, -1)["stop"]), lambda whole: F.transform(c, lambda p: cut(whole, p["start"] - first, p["stop"] - first)))

    last = F.aggregate(spans, F.lit(0).cast("bigint"), lambda x, s: F.greatest(x, s["stop"]))
    rest = F.substring(text, last.cast("int") + 1, F.length(text))
    kept = let(fresh, lambda f: F.array_join(F.flatten(F.transform(chunked(f), part)), mark))
    return F.when(F.size(spans) > 0, F.concat(kept, F.lit(mark), rest)).otherwise(text)
