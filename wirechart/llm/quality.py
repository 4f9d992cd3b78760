"""Quality rules: hard limits, then robust multivariate outliers by minimum covariance determinants.

Every text's counts are transformed to rates that are shrunk for short texts. For the corpus, each language, and each
language and source, concentration steps from several starts look for the part of the rows whose covariance has the
least determinant. A group's estimate is averaged with its language's, and that with the corpus's, each parent weighing as
much as ``PRIOR`` rows, so small groups lean on larger ones and no size decides between methods. Rows too far from their
group's centre by Mahalanobis distance are rejected.

Everything is DataFrame expressions: one aggregation a step, in bands of distance, so the part that a step takes is
``SOUND`` of a group to within the rows of one band. Matrices are inverted as arrays of a few groups, never per row.

Null texts have no words and fail the hard limits; null languages and sources form groups of their own. Texts of any length are
counted whole. Empty tables give empty results; ties and repeated rows are judged alike; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirechart.llm.shared import stored

#: Rows that a parent's estimate counts for; the part of a group that is taken for sound; concentration steps.
PRIOR, SOUND, STEPS = 100, 0.75, 3
#: The cut for squared distances: of normal rows, 1.5e-7 lie beyond 40 with 5 degrees of freedom.
CUT = 40.0
#: Median of the chi-squared distribution with 5 degrees of freedom.
MEDIAN_5 = 4.351
#: Bands of distance for each doubling; groups that are broadcast at most, and salts beyond that.
BANDS, BROADCAST, SALTS = 8, 50_000, 32
#: Spread that each rate has at least, in the order of RATES; the corpus's prior is WIDE times as wide.
SPREAD, WIDE = (0.03, 0.6, 0.12, 0.08, 0.4), 2.0
RATES = ("r_length", "r_symbols", "r_lines", "r_repeats", "r_capitals")
_P = range(len(RATES))
_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(hashes: Column, step: int) -> Column:
    n = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column, width: int) -> Column:
    """How many words lie in windows that occur twice or more."""
    places = let(
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())),
    )
    return let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width))), F.lit(0), lambda n, x: n + x))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of 8 words found twice or more, the first ones too."""
    assert width == 8
    size = F.size(words)
    windows = _paired
    found = let(
        let(let(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(h, 1)), lambda h: windows(h, 2)), lambda h: windows(h, 4)),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h, width)),
    )
    return F.when(size <= width, 0).otherwise(found)


def _removed(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts of every whole text beside the ``keep`` columns, and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*keep, text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: _removed(x, _SPACES) > 0))
    text = F.col("text")
    rows = rows.select(
        *keep,
        F.size("words").cast("bigint").alias("n_words"),
        _removed(text, _SPACES).cast("bigint").alias("word_chars"),
        (F.length(text) - _removed(text, _SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.length(text) - _removed(text, _CAPITALS)).cast("bigint").alias("n_capitals"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _rates(rows: DataFrame) -> DataFrame:
    n = F.col("n_words") + 50
    return rows.withColumns({
        "r_length": F.log((F.col("word_chars") + 250) / n),
        "r_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "r_lines": F.col("n_dup_lines") / (F.col("n_lines") + 5),
        "r_repeats": F.col("n_repeat_words") / n,
        "r_capitals": F.log1p(100 * F.col("n_capitals") / (F.col("word_chars") + 250)),
    })


def joined(rows: DataFrame, table: DataFrame, key: str, most: int = BROADCAST) -> DataFrame:
    """rows with a written table of groups: broadcast up to ``most`` groups, else by key and salt, so a hot group isn't gathered."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _moments(weight: Column, at: list[Column]) -> list[Column]:
    """Sums of a weight, of weighted values and of their products, for an aggregation."""
    first = [F.sum(weight * x).alias(f"s{i}") for i, x in enumerate(at)]
    second = [F.sum(weight * at[i] * at[j]).alias(f"s{i}{j}") for i in _P for j in range(i + 1)]
    return [F.sum(weight).alias("w"), *first, *second]


_SUMS = ["w", *[f"s{i}" for i in _P], *[f"s{i}{j}" for i in _P for j in range(i + 1)]]


def _flat(entry) -> Column:
    """A symmetric matrix as one array, row by row; entry(i, j) for j <= i."""
    return F.array(*[entry(max(i, j), min(i, j)) for i in _P for j in _P])


def _centre_and_spread() -> list[Column]:
    """(m, cov) from the sums of ``_moments``; floors keep a rate without variance from being infinitely strict."""
    w = F.greatest("w", F.lit(1e-9))
    cov = _flat(lambda i, j: F.col(f"s{i}{j}") / w - F.col(f"s{i}") * F.col(f"s{j}") / (w * w) + (F.get("floor", F.lit(i)) if i == j else 0.0))
    return [F.array(*[F.col(f"s{i}") / w for i in _P]).alias("m"), cov.alias("cov")]


def inverted(matrix: Column) -> Column:
    """struct(a: inverse, logdet) of a positive definite matrix in one array, by Gauss-Jordan steps."""
    n = len(RATES)

    def step(acc: Column, k: Column) -> Column:
        a, pivot = acc["a"], F.get(acc["a"], k * (n + 1))

        def entry(x: Column, t: Column) -> Column:
            j = t % n
            i = ((t - j) / n).cast("int")
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, x / pivot).when(j == k, -x / pivot).otherwise(x - F.get(a, i * n + k) * F.get(a, k * n + j) / pivot)

        return F.struct(F.transform(a, entry).alias("a"), (acc["logdet"] + F.log(pivot)).alias("logdet"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.struct(matrix.alias("a"), F.lit(0.0).alias("logdet")), step)


def _distance(at: list[Column], centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    off = [x - F.get(centre, F.lit(i)) for i, x in enumerate(at)]
    terms = [F.get(inverse, F.lit(i * len(RATES) + j)) * off[i] * off[j] * (1.0 if i == j else 2.0) for i in _P for j in range(i + 1)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _band(d2: Column) -> Column:
    """Squared distances in bands, BANDS for each doubling."""
    return F.floor(BANDS * F.log2(d2 + 1e-6)).cast("int")


def _reached(share: float, keys: list[str]) -> Column:
    """Whether the bands below this one hold less than ``share`` of their group's rows."""
    below = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("w").over(below), F.lit(0.0)) < share * F.sum("w").over(Window.partitionBy(*keys))


def estimates(rows: DataFrame, steps: int = STEPS, sound: float = SOUND) -> DataFrame:
    """Per group g of rows(g, up, *RATES): up, n, centre m and covariance cov of its tightest part.

    Concentration runs from three starts at once (medians and quartiles; Cauchy weights; hyperbolic tangents), in units
    of each group's quartiles; the start that ends with the least determinant is kept.
    """
    quartiles = [F.percentile_approx(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, r in enumerate(RATES)]
    wide = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(SPREAD[i]))
    base = rows.groupBy("g").agg(F.min("up").alias("up"), F.count("*").alias("n"), *quartiles)
    base = stored(base.select("g", "up", "n", F.array(*[F.col(f"q{i}")[1] for i in _P]).alias("median"), F.array(*[wide(i) for i in _P]).alias("unit"), F.array(*[F.pow(SPREAD[i] / wide(i), 2) for i in _P]).alias("floor")), "quartiles")
    z = [F.col(f"z{i}") for i in _P]
    scaled = joined(rows, base.select("g", "median", "unit"), "g").select("g", *[((F.col(r) - F.get("median", F.lit(i))) / F.get("unit", F.lit(i))).alias(f"z{i}") for i, r in enumerate(RATES)])
    scaled = stored(scaled, "scaled")
    far = sum((x * x for x in z[1:]), z[0] * z[0])
    two = F.array(
        F.struct(F.lit(1).alias("s"), (1 / (1 + far / len(RATES))).alias("w"), *[x.alias(f"y{i}") for i, x in enumerate(z)]),
        F.struct(F.lit(2).alias("s"), F.lit(1.0).alias("w"), *[F.tanh(x).alias(f"y{i}") for i, x in enumerate(z)]),
    )
    begun = scaled.select("g", F.inline(two)).groupBy("g", "s").agg(*_moments(F.col("w"), [F.col(f"y{i}") for i in _P]))
    floors = base.select("g", "floor")
    begun = begun.join(floors, "g").select("g", "s", *_centre_and_spread())
    plain = base.select("g", F.lit(0).alias("s"), F.array(*[F.lit(0.0)] * len(RATES)).alias("m"), _flat(lambda i, j: F.lit(float(i == j))).alias("cov"))
    own = begun.unionByName(plain)
    for _ in range(steps):
        every = own.select("g", F.struct("s", "m", inverted(F.col("cov"))["a"].alias("inv")).alias("c")).groupBy("g").agg(F.collect_list("c").alias("starts"))
        near = joined(scaled, stored(every, "centres"), "g").select("g", *z, F.explode("starts").alias("c"))
        near = near.select("g", F.col("c.s").alias("s"), *z, _band(_distance(z, F.col("c.m"), F.col("c.inv"))).alias("band"))
        sums = near.groupBy("g", "s", "band").agg(*_moments(F.lit(1.0), z)).withColumn("taken", _reached(sound, ["g", "s"]))
        taken = sums.where("taken").groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in _SUMS])
        own = stored(taken.join(floors, "g").select("g", "s", *_centre_and_spread()), "concentrated")
    best = own.groupBy("g").agg(F.min_by(F.struct("m", "cov"), F.struct(inverted(F.col("cov"))["logdet"], F.col("s"))).alias("b"))
    out = best.join(base, "g")
    unit = lambda i: F.get("unit", F.lit(i))
    centre = F.array(*[F.get("median", F.lit(i)) + unit(i) * F.get("b.m", F.lit(i)) for i in _P])
    cov = F.array(*[F.get("b.cov", F.lit(i * len(RATES) + j)) * unit(i) * unit(j) for i in _P for j in _P])
    return out.select("g", "up", "n", centre.alias("m"), cov.alias("cov"))


def pooled(own: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(g, m, inv, level): each estimate as a mean with its parent's, which weighs as much as ``prior`` rows; the corpus's parent is wide."""
    mean = lambda a, b: F.zip_with(a, b, lambda x, y: (F.col("n") * x + prior * y) / (F.col("n") + prior))
    wide = _flat(lambda i, j: F.lit((WIDE * SPREAD[i]) ** 2 if i == j else 0.0))
    done = own.where("up is null").select("g", "m", mean(F.col("cov"), wide).alias("cov"), F.lit(0).alias("level"))
    last = done
    for level in (1, 2):
        above = last.select(F.col("g").alias("up"), F.col("m").alias("m_up"), F.col("cov").alias("cov_up"))
        last = own.join(above, "up").select("g", mean(F.col("m"), F.col("m_up")).alias("m"), mean(F.col("cov"), F.col("cov_up")).alias("cov"), F.lit(level).alias("level"))
        done = done.unionByName(last)
    return done.select("g", "m", inverted(F.col("cov"))["a"].alias("inv"), "level")


def judged(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), cut: float = CUT, prior: int = PRIOR) -> DataFrame:
    """``statistics`` with the rates, the squared distance d2 and kept; ``keep`` columns pass through."""
    kept = documents.select(F.struct(*keep).alias("row"), "text", "lang", "source")
    # written as text with a field for each value that isn't null, so groups with a null stay apart
    keys = {"g0": F.lit("0"), "g1": F.concat(F.lit("1"), F.to_json(F.struct("lang"))), "g2": F.concat(F.lit("2"), F.to_json(F.struct("lang", "source")))}
    rows = stored(_rates(statistics(kept, ("row", "lang", "source"))).withColumns(keys).drop("lang", "source"), "statistics")
    up = lambda g, u: F.struct(F.col(g).alias("g"), u.alias("up"))
    groups = F.array(up("g0", F.lit(None).cast("string")), up("g1", F.col("g0")), up("g2", F.col("g1")))
    own = stored(estimates(rows.where("not base_failed").select(F.inline(groups), *RATES)), "estimates")
    last = stored(pooled(own, prior).where("level = 2").select(F.col("g").alias("g2"), "m", "inv"), "pooled")
    # a row that failed the hard limits may have no group
    d2 = _distance([F.col(r) for r in RATES], F.col("m"), F.col("inv"))
    near = joined(rows.where("not base_failed").select("g2", *RATES), last, "g2").select("g2", _band(d2).alias("band")).groupBy("g2", "band").agg(F.count("*").cast("double").alias("w"))
    near = stored(near, "bands").withColumn("whole", F.lit("0"))
    every = near.groupBy("whole", "band").agg(F.sum("w").alias("w")).withColumn("taken", _reached(0.5, ["whole"])).where("taken").agg(F.max("band").alias("every"))
    each = near.withColumn("taken", _reached(0.5, ["g2"])).where("taken").groupBy("g2").agg(F.max("band").alias("each")).join(near.groupBy("g2").agg(F.sum("w").alias("n")), "g2")
    size = lambda band: F.greatest(F.pow(2.0, (F.col(band) + 0.5) / BANDS) / MEDIAN_5, F.lit(1.0))
    scale = each.join(F.broadcast(every)).select("g2", ((F.col("n") * size("each") + prior * size("every")) / (F.col("n") + prior)).alias("scale"))
    last = stored(last.join(scale, "g2"), "verdicts")
    good = joined(rows.where("not base_failed"), last, "g2").withColumn("d2", d2 / F.col("scale"))
    bad = rows.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    columns = [c for c in rows.columns if c not in ("row", "g0", "g1", "g2")]
    out = good.select("row", *columns, "d2").unionByName(bad.select("row", *columns, "d2"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *columns, "d2", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)).alias("kept"))


def drop_rejected(documents: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; whole rows are written once beside their statistics and not joined again."""
    rows = documents.select(F.struct("*").alias("whole"), "text", "lang", "source")
    return judged(rows, ("whole",)).where("kept").select(*[F.col("whole").getField(c).alias(c) for c in documents.columns])
