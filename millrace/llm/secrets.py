"""Secret scans with DataFrame functions only.

Fixed patterns give the base spans. The method adds long tokens that look random, in what the base spans leave of the text:
character Markov models of random strings and of ordinary identifiers are trained from labelled samples, and a token whose
log-likelihood ratio between the two is high enough becomes a span of kind ``random``. Positions are code points: text is split at
the matches, and the lengths of the pieces and the matches add up to the positions, chunk by chunk, so that many matches in one
text take time in proportion.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh

#: Kinds in order, their patterns, the group that is measured, and its least length.
KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # A run of one character class that is too short has no longer match inside, so the least length stands in the pattern.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the added kind: runs of at least so many characters with a digit and a letter.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Matches whose positions are added up at a time.
_CHUNK = 256
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Mean log-likelihood ratio for each character pair from which a candidate is a secret.
RATIO = 0.4
SAMPLES = 4000

_WORDS = (
    "get set user name file path data list item index count size total value key table column row page next prev first last "
    "open close read write load save init config option param result error message event handler listener request response "
    "client server session context manager service factory builder parser reader writer buffer stream string number date time "
    "start end begin finish update delete insert create remove find search sort filter map reduce group join split merge"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``(text, is_random)``: ``n`` random strings (base 64 and hexadecimal digests) and ``n`` identifiers (compounds of common
    words in several styles, some with numbers), made by rule, the same each time."""
    words = F.array(*map(F.lit, _WORDS))
    pick = lambda k: words[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))).cast("int")]
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(F.base64(F.unhex(digest)), 1, 40))
    parts = [pick(k) for k in range(4)]
    number = F.when(F.col("id") % 4 == 0, (F.col("id") % 2000).cast("string")).otherwise("")
    style = F.col("id") % 5
    identifier = (
        F.when(style == 0, F.concat_ws("_", *parts, number)).when(style == 1, F.concat_ws("-", *parts))
        .when(style == 2, F.concat(parts[0], *(F.initcap(p) for p in parts[1:]), number))
        .when(style == 3, F.concat_ws("/", *parts)).otherwise(F.upper(F.concat_ws("_", *parts[:3])))
    )
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(True).alias("is_random")).union(ids.select(identifier, F.lit(False)))


def train(samples: DataFrame) -> dict[str, float]:
    """Log-likelihood ratios of all character pairs of the alphabet, from add-half counts of the labelled samples. The
    table has a fixed size; characters outside the alphabet are left out."""
    n = len(ALPHABET)
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = samples.where("text is not null").select(
        "is_random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substr(F.col("text"), i, F.lit(2)))).alias("pair")
    ).where(F.length("pair") == 2)
    rows = pairs.groupBy("is_random", "pair").agg(F.count("*").alias("n")).where((at(F.substring("pair", 1, 1)) > 0) & (at(F.substring("pair", 2, 1)) > 0)).collect()
    counts: dict[bool, dict[str, float]] = {True: {}, False: {}}
    for r in rows:
        counts[r.is_random][r.pair] = r.n
    out = {}
    for a in ALPHABET:
        sums = {k: sum(counts[k].get(a + b, 0) for b in ALPHABET) + 0.5 * n for k in counts}
        for b in ALPHABET:
            chance = {k: (counts[k].get(a + b, 0) + 0.5) / sums[k] for k in counts}
            out[a + b] = log(chance[True] / chance[False])
    return out


def _ratio(text: Column, model: dict[str, float]) -> Column:
    """The mean log-likelihood ratio over the character pairs of ``text``."""
    n = len(ALPHABET)
    # One literal, folded to an array when the query is planned.
    table = F.split(F.lit(",".join(f"{model[a + b]:.6f}" for a in ALPHABET for b in ALPHABET)), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substr(text, i, F.lit(1))) - 1
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(text) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, place(i) * n + place(i + 1))
    )
    return total / (F.length(text) - 1)


def _pieces(text: Column, pattern: str, group: int) -> tuple[Column, Column]:
    """Whether there is a match; the text before each match, the match and its measured group, the last one with a null match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return F.size(whole) > 0, F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("m"), measured.alias("g"))


_NONE = "cast(array() as array<struct<s:int,e:int,g:string>>)"


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """An array of ``(s, e, g)``: start and end of each match in code points, and the measured group; short ones are left out."""
    some, zipped = _pieces(text, pattern, group)
    lengths = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(-1)).alias("n"), x["g"].alias("g")))
    taken = lambda x: x["gap"] + F.greatest(x["n"], F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda k: F.slice(lengths, k * _CHUNK + 1, F.lit(_CHUNK)))
    begins = lambda chunks: F.aggregate(
        chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(c, F.lit(0), lambda n, x: n + taken(x))))
    )

    def spans(chunk: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.array(F.struct(start.alias("s"), (start + x["n"]).alias("e"), x["g"].alias("g")))
            long = (x["n"] >= 0) & (F.length(x["g"]) >= least)
            return F.struct((acc["at"] + taken(x)).alias("at"), F.when(long, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), F.expr(_NONE).alias("out")), step)["out"]

    # A value in an array of one is computed once, not again in each use.
    found = F.transform(F.array(chunks), lambda c: F.flatten(F.zip_with(c, F.slice(begins(c), F.lit(1), F.size(c)), spans)))
    return F.when(some, F.get(found, F.lit(0))).otherwise(F.expr(_NONE))


def _blanked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with blanks in place of its long enough matches; no position changes."""
    some, zipped = _pieces(text, pattern, group)
    one = lambda x: F.concat(x["gap"], F.when(x["m"].isNull(), "").when(F.length(x["g"]) >= least, F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"]))
    return F.when(some, F.array_join(F.transform(zipped, one), "")).otherwise(text)


def scan(docs: DataFrame, model: dict[str, float], text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """Every column of ``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_spans`` and ``spans``: arrays of
    ``(s, kind, e)`` in code points (end exclusive) by start, then kind as listed; ``spans`` also has the kind ``random``.

    Matches are leftmost and do not overlap within a kind; those whose measured part is too short are dropped afterwards.
    Added spans are sought in what is left when base matches are blanked, one kind after the other. A null text is read as
    empty and has no spans. Input columns named like the new ones are replaced, others stay as they are; equal rows stay apart.
    """
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    docs = docs.drop(*new)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {kind: fresh(docs, f"found_{kind}") for kind, *_ in KINDS}
    base, rest, likely = (fresh(docs, name) for name in ("base", "rest", "likely"))
    found = docs.select("*", *(_matches(text, pattern, group, least).alias(own[kind]) for kind, pattern, group, least in KINDS))
    tagged = lambda name, k: F.transform(F.col(own[name]), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    found = found.withColumn(base, F.array_sort(F.concat(*(tagged(kind, k) for k, (kind, *_) in enumerate(KINDS))))).withColumn(rest, text)
    for _, pattern, group, least in KINDS:
        found = found.withColumn(rest, F.when(F.size(base) > 0, _blanked(F.col(rest), pattern, group, least)).otherwise(F.col(rest)))
    mixed = lambda x: x["g"].rlike("[0-9]") & x["g"].rlike("[A-Za-z]")
    found = found.withColumn(likely, F.filter(_matches(F.col(rest), CANDIDATE, 0, 0), mixed))
    scored = F.filter(F.col(likely), lambda x: _ratio(x["g"], model) >= ratio)
    added = F.transform(scored, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit("random"))
    named = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.get(names, x["k"]).alias("kind"), x["e"].alias("e")))
    every = F.when(F.size(likely) > 0, F.array_sort(F.concat(F.col(base), added))).otherwise(F.col(base))
    counts = (F.size(own[kind]).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS)
    return found.select(*docs.columns, *counts, named(F.col(base)).alias("base_spans"), named(every).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
