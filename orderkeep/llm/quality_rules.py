"""Quality rules: base limits, then robust multivariate outliers per language and source. DataFrame functions only.

Of each text come counts of words, characters, symbols, repeated lines and words in repeated five-word windows, and
from them a vector of transformed statistics: the logarithm of the mean word length, taken from the group's median and
multiplied by sqrt(n / (n + DAMP_WORDS)), n the words, as a short text's mean varies by chance; and log(1 + 10 * share) of
symbols per word, of repeated lines (per lines and DAMP_LINES more, so that one of three counts for little) and of words
in repeated windows.

For each language and source the centre and scatter are minimum-covariance-determinant estimates. Most texts have no
symbols and repeat nothing, so the scatter of the COVER share of rows is singular for these statistics; the determinant
that is minimised is that of the regularised scatter, CONSISTENT * S + diag(SCALE ** 2) (a statistic without spread has
the deviation SCALE, one with spread mostly its own). From three starts (coordinatewise median, mean and covariance of
all rows, most frequent vector) concentration steps take the COVER share of rows that lie nearest and estimate anew from
these, until the determinant falls no more; of all the least determinant wins. Rows whose squared Mahalanobis distance
exceeds the cut-off for TAIL are rejected.

Estimates are found from a histogram: vectors on a lattice of steps of 1 / STEPS_PER_UNIT with their numbers of rows, so
that the table the steps run over is bounded by the lattice and not by the rows, its sums are exact, and the share taken
is exact as well (of the last cell only as many rows as are wanted count).

Sources of fewer than MIN_ROWS rows in a language are pooled by language; a pool below that rejects nothing. Only rows
that pass the base limits enter the estimates. Estimates are a row for each group; they are joined by broadcast while
they are MAX_SMALL_GROUPS at most, else by a shuffle.

Defined results: a null text has no words, fails the base limits and isn't kept; null languages and sources are groups
of their own; rows are judged one by one, so repeated rows agree; an empty table gives an empty result. Other columns
of the input are passed on unless a result has their name. Two different windows of a text count as one where their
64-bit hashes agree (a chance of about n * n / 2**65 for a text of n words). A text's word hashes are held in memory
some 60 bytes for each word, so a text of 100 MB needs about 1 GB in its task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderkeep.llm.common import table
from orderkeep.session import cut, stored

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COVER = 0.75
MIN_ROWS = 50
DAMP_WORDS, DAMP_LINES = 100, 5
STEPS_PER_UNIT = 128
#: Bins of a squared distance for each factor of e.
BINS = 16
#: For each statistic the deviation that one without spread in a group is given.
SCALE = (0.03, 0.15, 0.4, 0.22)
#: The chance that a row of a normal group is rejected.
TAIL = 1e-4
MAX_SMALL_GROUPS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
D = len(SCALE)
X = tuple(f"__x{i}" for i in range(D))
C = tuple(f"__c{i}" for i in range(D))
LOW = [(i, j) for i in range(D) for j in range(i + 1)]
STATE = ("__det", *(f"__m{i}" for i in range(D)), *(f"__l{i}{j}" for i, j in LOW))


def _chi2_below(x: float, d: int) -> float:
    """The share of a chi-square distribution of d (even) degrees of freedom below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def _chi2_point(above: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - _chi2_below(mid, d) > above:
            low = mid
        else:
            high = mid
    return high


CUTOFF = _chi2_point(TAIL, D)
#: Makes the scatter of the nearest COVER of normal rows that of all.
CONSISTENT = COVER / _chi2_below(_chi2_point(1 - COVER, D), D + 2)


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    names = ("__w", "__v", "__h", "__lines", *BASE, "base_failed")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaced = text
    for c in "\t\n\u000b\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    own = lambda df: [F.col(f"`{c}`") for c in df.columns]
    a = df.select(*keep, F.array_remove(F.split(spaced, F.lit(" ")), "").alias("__w"), F.filter(F.split(text, F.lit("\n")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    a = a.select(*own(a), F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"))
    # a window's hash: of the five words' hashes
    window = F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("__h", i + 1), F.get("__h", i + 2), F.get("__h", i + 3), F.get("__h", i + 4)))
    a = a.select(*own(a), window.alias("__v"))
    placed = F.sort_array(F.transform("__v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]))
    # each repeated window adds the words that the one before has not
    covered = lambda s: F.aggregate(F.sort_array(F.transform(twice(s), lambda e: e["i"])), F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    a = a.select(*own(a), F.when(F.size(F.array_distinct("__v")) < F.size("__v"), placed).alias("__s"))
    a = a.select(
        *(F.col(f"`{c}`") for c in a.columns if not c.startswith("__")),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        F.when(F.col("__s").isNull(), 0).otherwise(covered(F.col("__s"))).cast("long").alias("n_repeat_words"),
    )
    return a.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_vector(df: DataFrame) -> DataFrame:
    """The statistics and the group of rows that with_counts() made. Values are rounded to fixed binary places, so that
    sums of them do not depend on the order of rows. The first is still to be taken from its group's median."""
    n = F.greatest("n_words", F.lit(1))
    per = lambda c, to: F.log1p(10 * F.col(c) / to)
    vector = (F.log(F.greatest("word_chars", F.lit(1)) / n), per("n_symbols", n), per("n_dup_lines", F.col("__n_lines") + DAMP_LINES), per("n_repeat_words", n))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    out = df.withColumns({name: F.round(x * 4096) / 4096 for name, x in zip(X, vector, strict=True)})
    return out.withColumns({"__damp": F.round(4096 * F.sqrt(n / (n + DAMP_WORDS))) / 4096, "__lang": part("lang"), "__group": F.concat(part("lang"), F.lit("\u0001"), part("source"))})


def _join(rows: DataFrame, groups: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """groups: a checkpointed row for each group; broadcast if few."""
    return rows.join(F.broadcast(groups) if groups.count() <= MAX_SMALL_GROUPS else groups, on, how)


def _vector() -> list[Column]:
    """The statistics, the first from the group's median __mid on."""
    return [(F.col(X[0]) - F.col("__mid")) * F.col("__damp"), *(F.col(x) for x in X[1:])]


def _distance(x: list[Column]) -> Column:
    """The squared distance of x by a centre __m* and the factor __l* of a scatter (forward substitution)."""
    z: list[Column] = []
    for i in range(D):
        left = x[i] - F.col(f"__m{i}")
        for k in range(i):
            left = left - F.col(f"__l{i}{k}") * z[k]
        z.append(left / F.col(f"__l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _apart(df: DataFrame) -> DataFrame:
    """df; Spark keeps what comes after apart from the expressions before instead of putting them into each other."""
    return df.select(F.inline(F.array(F.struct(*(F.col(c) for c in df.columns)))))


def _estimate(cells: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Of the cells by pool: centre __m*, lower Cholesky factor __l* of the regularised scatter and its determinant's root."""
    sums = {"w": F.sum(weight).cast("double")} | {f"s{i}": F.sum(weight * F.col(C[i])) for i in range(D)} | {f"p{i}{j}": F.sum(weight * F.col(C[i]) * F.col(C[j])) for i, j in LOW}
    g = _apart(cells.groupBy(*by).agg(*(c.alias(k) for k, c in sums.items())))
    g = _apart(g.select("*", *((F.col(f"s{i}") / F.col("w")).alias(f"__m{i}") for i in range(D))))
    g = g.select("*", *((CONSISTENT * (F.col(f"p{i}{j}") / F.col("w") - F.col(f"__m{i}") * F.col(f"__m{j}")) + (SCALE[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in LOW))
    for j in range(D):
        rest = F.col(f"c{j}{j}")
        for k in range(j):
            rest = rest - F.col(f"__l{j}{k}") * F.col(f"__l{j}{k}")
        g = _apart(g.withColumn(f"__l{j}{j}", F.sqrt(rest)))
        for i in range(j + 1, D):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            g = g.withColumn(f"__l{i}{j}", rest / F.col(f"__l{j}{j}"))
    det = F.col("__l00")
    for j in range(1, D):
        det = det * F.col(f"__l{j}{j}")
    return g.withColumn("__det", det).select(*by, *STATE)


def _medians(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(__pool, columns): the lower medians of cells' columns, from the numbers of rows by value."""
    values = cells.select("__pool", "__n", F.posexplode(F.array(*columns)).alias("d", "x")).groupBy("__pool", "d", "x").agg(F.sum("__n").alias("n"))
    # a row for each value of the lattice
    upto, whole = Window.partitionBy("__pool", "d").orderBy("x"), Window.partitionBy("__pool", "d")
    half = values.select("__pool", "d", "x", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all")).filter(2 * F.col("upto") >= F.col("all"))
    return half.groupBy("__pool").agg(*(F.min(F.when(F.col("d") == k, F.col("x"))).alias(c) for k, c in enumerate(columns)))


def starts(cells: DataFrame) -> DataFrame:
    """(__pool, __start, centre, factor, determinant): median, mean and most frequent vector of each pool's cells."""
    plain = [F.lit(math.inf).alias("__det"), *(F.col(c).alias(f"__m{i}") for i, c in enumerate(C)), *(F.lit(SCALE[i] if i == j else 0.0).alias(f"__l{i}{j}") for i, j in LOW)]
    middle = _medians(cells, C).select("__pool", F.lit(0).alias("__start"), *plain)
    mean = _estimate(cells, ["__pool"], F.col("__n")).withColumn("__det", F.lit(math.inf)).select("__pool", F.lit(1).alias("__start"), *STATE)
    most = cells.groupBy("__pool").agg(F.max(F.struct("__n", *C)).alias("top")).select("__pool", *(F.col(f"top.{c}").alias(c) for c in C))
    return middle.unionByName(mean).unionByName(most.select("__pool", F.lit(2).alias("__start"), *plain))


def concentrate(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step of each chain (__pool, __start): estimates from the nearest COVER share of its pool's rows."""
    near = _join(cells, state, "__pool").withColumn("__d2", _distance([F.col(c) for c in C])).withColumn("__bin", F.floor(BINS * F.log(F.col("__d2") + 1e-9)))
    # rows by bins of the distance, which spread a large pool; then by distance in each bin
    chain, upto = ["__pool", "__start"], Window.unboundedPreceding
    bins = near.groupBy(*chain, "__bin").agg(F.sum("__n").alias("m"))
    over = Window.partitionBy(*chain)
    bins = bins.select(*chain, "__bin", (F.ceil(COVER * F.sum("m").over(over)) - F.coalesce(F.sum("m").over(over.orderBy("__bin").rowsBetween(upto, -1)), F.lit(0))).alias("__room"))
    order = Window.partitionBy(*chain, "__bin").orderBy("__d2", *C).rowsBetween(upto, -1)
    before = F.coalesce(F.sum("__n").over(order), F.lit(0))
    taken = near.join(bins, [*chain, "__bin"]).withColumn("__w", F.greatest(F.least(F.col("__n"), F.col("__room") - before), F.lit(0)))
    return _estimate(taken.filter("__w > 0"), ["__pool", "__start"], F.col("__w"))


def determinants(cells: DataFrame) -> DataFrame:
    """(__pool, centre, factor, determinant's root): the least determinant of all starts' chains. A chain ends when its
    determinant falls no more, which it must, as there are finitely many subsets."""
    state = cut(starts(cells))
    best = None
    while True:
        after = concentrate(cells, state.select("__pool", "__start", *STATE)).join(state.select("__pool", "__start", F.col("__det").alias("__old")), ["__pool", "__start"])
        state = cut(after.filter(F.col("__det") < F.col("__old")).drop("__old"))
        if not state.count():
            break
        found = state.select("__pool", F.struct("__det", "__start", *STATE[1:]).alias("s"))
        both = found if best is None else best.unionByName(found)
        best = cut(both.groupBy("__pool").agg(F.min("s").alias("s")))
    if best is None:  # no pools
        return state.select("__pool", *STATE)
    return best.select("__pool", *(F.col(f"s.{c}").alias(c) for c in STATE))


def fit(vectors: DataFrame) -> DataFrame:
    """Estimates for each group of rows that with_vector() made: (__group, __mid, __det, __m*, __l*); a group without has no row."""
    passed = vectors.filter(~F.col("base_failed")).select("__lang", "__group", "__damp", *X)
    sizes = cut(passed.groupBy("__lang", "__group").agg(F.count("*").alias("n")))
    # sources with enough rows are pools; of each language the others together
    pools = sizes.select("__group", F.when(F.col("n") >= MIN_ROWS, F.col("__group")).otherwise(F.concat(F.lit("~"), "__lang")).alias("__pool"), "n")
    enough = pools.groupBy("__pool").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= MIN_ROWS).select("__pool")
    pools = cut(pools.join(enough, "__pool").select("__group", "__pool"))
    rows = _join(passed, pools, "__group")
    middle = cut(_medians(rows.groupBy("__pool", X[0]).agg(F.count("*").alias("__n")), X[:1]).withColumnRenamed(X[0], "__mid"))
    lattice = [F.round(x * STEPS_PER_UNIT) / STEPS_PER_UNIT for x in _vector()]
    cells = cut(_join(rows, middle, "__pool").select("__pool", *(x.alias(c) for x, c in zip(lattice, C, strict=True))).groupBy("__pool", *C).agg(F.count("*").alias("__n")))
    found = determinants(cells)
    return cut(pools.join(middle, "__pool").join(found, "__pool").drop("__pool"))


def judge(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """The rows that with_vector() made with kept: whether they pass the base limits and lie within the cut-off."""
    got = _join(vectors, estimates, "__group", "left")
    return got.withColumn("kept", ~F.col("base_failed") & F.coalesce(_distance(_vector()) <= CUTOFF, F.lit(True)))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    counts = with_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    vectors = cut(with_vector(counts).select("doc_id", *BASE, "base_failed", "__lang", "__group", "__damp", *X))
    return judge(vectors, fit(vectors)).select("doc_id", *BASE, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept.

    Documents and their statistics are written once and read again: a filter on the verdict would otherwise be pushed
    down to the texts, and its expressions, put into each other, take far more than one pass."""
    vectors = stored(with_vector(with_counts(docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source"))).drop("text", "lang", "source"))
    return judge(vectors, fit(vectors)).filter("kept").select("row.*")


def sql() -> str:
    """SQL with op8's rows: the same counts, vectors, starts and steps written out, with the constants above."""
    n, dims = "greatest(n_words, 1)", range(D)
    per = lambda c, to: f"ln(1 + 10 * {c} / {to})"
    vector = (f"ln(greatest(word_chars, 1) / {n})", per("n_symbols", n), per("n_dup_lines", f"(n_lines + {DAMP_LINES})"), per("n_repeat_words", n))
    each = lambda form, over=dims: ", ".join(form(i) for i in over)
    pairs = lambda form: ", ".join(form(i, j) for i, j in LOW)
    z = lambda x: each(lambda i: f"({x}{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} AS z{i}")
    d2 = " + ".join(f"z{i} * z{i}" for i in dims)
    number = lambda v: f"{v!r}::DOUBLE"
    diagonal = pairs(lambda i, j: f"{number(SCALE[i] if i == j else 0.0)} AS l{i}{j}")
    state = ", ".join(["det", *(f"m{i}" for i in dims), *(f"l{i}{j}" for i, j in LOW)])
    steps = []
    for j in dims:
        steps.append(f"sqrt(c{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}) AS l{j}{j}")
        steps += [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, D)]

    def estimate(source: str, by: str, w: str) -> str:
        return f"""SELECT {by}, {", ".join(steps)}, {" * ".join(f"l{j}{j}" for j in dims)} AS det, {each(lambda i: f"m{i}")} FROM (
    SELECT *, {each(lambda i: f"s{i} / w AS m{i}")}, {pairs(lambda i, j: f"{number(CONSISTENT)} * (p{i}{j} / w - m{i} * m{j}) + {number(SCALE[i] ** 2 if i == j else 0.0)} AS c{i}{j}")} FROM (
      SELECT {by}, sum({w})::DOUBLE AS w, {each(lambda i: f"sum({w} * c{i}) AS s{i}")}, {pairs(lambda i, j: f"sum({w} * c{i} * c{j}) AS p{i}{j}")} FROM {source} GROUP BY {by}))"""

    near = f"""(SELECT *, greatest(least(n, ceil({number(COVER)} * sum(n) OVER (PARTITION BY pool, start)) - coalesce(sum(n) OVER (PARTITION BY pool, start ORDER BY d2, c0, c1, c2, c3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS wt
        FROM (SELECT cells.*, start, chain.det AS old, {z("c")}, {d2} AS d2 FROM cells JOIN chain USING (pool)))"""

    return rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
v AS (SELECT r, unnest(range(0, len(ws) - 4)) AS pos, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS win FROM w WHERE len(ws) >= 5),
twice AS (SELECT r, pos FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS c FROM v) WHERE c > 1),
hit AS (SELECT r, sum(least(5, pos - before)) AS words FROM (SELECT r, pos, lag(pos, 1, -5) OVER (PARTITION BY r ORDER BY pos) AS before FROM twice) GROUP BY r),
counts AS (SELECT w.doc_id, w.lang, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN hit USING (r)),
vec AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"round({x} * 4096) / 4096 AS x{i}" for i, x in enumerate(vector))},
  round(4096 * sqrt({n} / ({n} + {DAMP_WORDS}))) / 4096 AS damp, coalesce('=' || lang, '-') AS lg, lg || chr(1) || coalesce('=' || source, '-') AS grp FROM counts),
sizes AS (SELECT grp, CASE WHEN count(*) >= {MIN_ROWS} THEN grp ELSE '~' || lg END AS pool, count(*) AS n FROM vec WHERE NOT base_failed GROUP BY lg, grp),
pools AS MATERIALIZED (SELECT grp, pool FROM sizes WHERE pool IN (SELECT pool FROM sizes GROUP BY pool HAVING sum(n) >= {MIN_ROWS})),
passed AS MATERIALIZED (SELECT vec.*, pool FROM vec JOIN pools USING (grp) WHERE NOT base_failed),
middle AS MATERIALIZED (SELECT pool, quantile_disc(x0, 0.5) AS mid FROM passed GROUP BY pool),
cells AS MATERIALIZED (SELECT pool, round((x0 - mid) * damp * {STEPS_PER_UNIT}) / {STEPS_PER_UNIT} AS c0, {each(lambda i: f"round(x{i} * {STEPS_PER_UNIT}) / {STEPS_PER_UNIT} AS c{i}", range(1, D))}, count(*) AS n FROM passed JOIN middle USING (pool) GROUP BY ALL),
middles AS (SELECT pool, {each(lambda i: f"quantile_disc(round({f'(x0 - mid) * damp' if i == 0 else f'x{i}'} * {STEPS_PER_UNIT}) / {STEPS_PER_UNIT}, 0.5) AS m{i}")} FROM passed JOIN middle USING (pool) GROUP BY pool),
mean AS ({estimate("cells", "pool", "n")}),
most AS (SELECT pool, unnest(max(struct_pack(n := n, {each(lambda i: f"m{i} := c{i}")}))) FROM cells GROUP BY pool),
chain(pool, start, {state}) AS (
  SELECT pool, 0, 'inf'::DOUBLE, {each(lambda i: f"m{i}")}, {diagonal} FROM middles
  UNION ALL SELECT pool, 1, 'inf'::DOUBLE, {each(lambda i: f"m{i}")}, {pairs(lambda i, j: f"l{i}{j}")} FROM mean
  UNION ALL SELECT pool, 2, 'inf'::DOUBLE, {each(lambda i: f"m{i}")}, {diagonal} FROM most
  UNION ALL SELECT pool, start, {state} FROM ({estimate(near, "pool, start, old", "wt")}) WHERE det < old),
best AS (SELECT pool, unnest(min(struct_pack(det := det, start := start, {each(lambda i: f"m{i} := m{i}")}, {pairs(lambda i, j: f"l{i}{j} := l{i}{j}")}))) FROM chain WHERE det < 'inf'::DOUBLE GROUP BY pool),
verdict AS (SELECT vec.*, (x0 - mid) * damp AS y0, {each(lambda i: f"x{i} AS y{i}", range(1, D))}, {z("y")}, {d2} AS d2 FROM vec LEFT JOIN pools USING (grp) LEFT JOIN middle USING (pool) LEFT JOIN best USING (pool))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {number(CUTOFF)}, TRUE) AS kept FROM verdict"""


OP8_SQL = sql()
