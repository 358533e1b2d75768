"""Regression trees of every series at once (M9, M11): random forest and gradient boosting.

A model belongs to one series (its key columns), as in the reference, but no series is fitted on its own: each level
of all trees that can grow together, of all families and all series, is one grouped sum. Feature values are binned once, between
a series' smallest and largest; a level sums gradients and rows by (series, tree, node, feature, bin), running sums over the bins give the gain of
every split, and a grouped maximum picks the best. A forest's trees all grow in one round; a
boosted model grows one tree a round.

Gradients are whole numbers of ``UNIT`` (the labels' grid), so sums do not depend on the order of rows. A tree is arrays
over heap places (children of n: 2n, 2n + 1), walked by expressions; between levels only the splits are written,
between rounds the predictions so far. Series rows are never gathered in one task.

Defined cases: a null or NaN feature goes left of every split; rows without a label are left out; a feature that is
constant in a series never splits; ties go to the lower feature, then the lower bin; a series whose rows
allow no split has trees of one leaf (their mean); a series without rows has no model, and its predictions are null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import SEARCH_SEED
from airlattice.operators import evaluate as E
from airlattice.operators.joins import join_stats
from airlattice.session import cut_lineage

UNIT = 1e-6
BINS = 64
# Upper bounds of a Poisson(1) variable's distribution: how often a bootstrap draws a row (fixed values).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


@dataclass(frozen=True)
class Growth:
    """How the trees of a family grow."""
    trees: int
    depth: int
    forest: bool = False
    rate: float = 1.0          # share of a boosted tree's step
    l2: float = 0.0
    min_leaf: int = 1
    min_gain: float = 0.0
    leaves: int | None = None  # of a tree at most; the best gains of a level come first
    rows: float = 1.0          # share of rows of a boosted tree; a forest draws with replacement
    columns: float = 1.0       # share of features, per tree (boosted) or node (forest)
    skip: int | None = None    # the fold that is left out, to be predicted


# The families that the reference has enabled. LightGBM grows few leaves by best gain, XGBoost levels with a
# penalty, the forest deep trees of a third of the features.
FAMILIES = {
    "RandomForest": Growth(trees=100, depth=10, forest=True, min_leaf=2, columns=1 / 3),
    "LightGBM": Growth(trees=100, depth=5, rate=0.1, min_leaf=20, leaves=20),
    "XGBoost": Growth(trees=100, depth=6, rate=0.1, l2=1.0),
}


def edges(rows: DataFrame, keys: list[str], features: list[str], bins: int = BINS) -> DataFrame:
    """Per series the smallest value and the bin width of every feature, as arrays ``lo`` and ``width``."""
    def number(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)
    agg = rows.groupBy(*keys).agg(F.array(*[F.min(number(c)) for c in features]).alias("lo"),
                                  F.array(*[F.max(number(c)) for c in features]).alias("_hi"))
    return agg.select(*keys, "lo", F.expr(f"transform(_hi, (h, i) -> (h - lo[i]) / {float(bins)!r}D)").alias("width"))


def binned(x: str, bins: int = BINS) -> str:
    """SQL text: the bins of the feature array ``x`` given ``lo`` and ``width``; -1 for a missing value."""
    return (f"transform({x}, (v, i) -> CASE WHEN v IS NULL OR isnan(v) OR lo[i] IS NULL THEN -1 WHEN width[i] = 0 THEN 0 "
            f"ELSE CAST(least({bins - 1}, greatest(0, floor((v - lo[i]) / width[i]))) AS INT) END)")


def walk(tree: str, x: str, depth: int) -> str:
    """SQL text: the place in ``tree`` (f, b) where a row with bins ``x`` ends."""
    return (f"aggregate(sequence(1, {depth}), 1, (n, i) -> CASE WHEN try_element_at({tree}.f, n) IS NULL THEN n "
            f"ELSE 2 * n + IF({x}[{tree}.f[n - 1]] > {tree}.b[n - 1], 1, 0) END)")


def _draw(*parts) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


@dataclass(frozen=True)
class Track:
    """A tree that grows in this round."""
    model: str
    tree: int
    growth: Growth
    place: int | None = None   # of its predictions so far; a forest has none


def _nodes(rows: DataFrame, grown: DataFrame | None, keys: list[str], tracks: list[Track], seed: int, row: list[str]) -> DataFrame:
    """One row per row and tree that draws it: keys, track, node, gradient (UNIT) and weight, b."""
    depth = max(t.growth.depth for t in tracks)
    if grown is not None:
        rows = join_stats(rows, grown, keys)
    each = rows.withColumn("_k", F.explode(F.array(*[F.struct(
        F.lit(k).alias("track"), F.lit(t.model).alias("model"), F.lit(t.tree).alias("tree"), F.lit(t.growth.forest).alias("forest"),
        F.lit(t.place).cast("int").alias("place"), F.lit(t.growth.skip).cast("int").alias("skip"), F.lit(float(t.growth.rows)).alias("rows"))
        for k, t in enumerate(tracks)])))
    u = _draw(F.lit(seed), "_k.model", "_k.tree", *row)
    times = F.when(F.col("_k.forest"), F.size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: F.col("_u") >= p))).otherwise(
        (F.col("_u") < F.col("_k.rows")).cast("int"))
    each = each.withColumn("_u", u).withColumn("w", times).where("w > 0")
    if any(t.growth.skip is not None for t in tracks):
        each = each.where("_k.skip IS NULL OR _k.skip <> _fold")
    node = F.lit(1) if grown is None else F.expr(f"IF(_trees[_k.track] IS NULL, 1, {walk('_trees[_k.track]', 'b', depth)})")
    g = F.col("y") - F.when(F.col("_k.place").isNull(), F.lit(0)).otherwise(F.round(F.get("_p", "_k.place")).cast("long"))
    return each.select(*keys, "b", F.col("_k.track").alias("track"), node.alias("node"), (g * F.col("w")).alias("g"), "w")


def candidates(nodes: DataFrame, keys: list[str], l2: Column, min_leaf: Column) -> DataFrame:
    """Every split that leaves enough rows on both sides: keys, track, node, feature, bin, n_left, gain."""
    hist = (nodes.select(*keys, "track", "node", "g", "w", F.posexplode("b").alias("feature", "bin"))
            .groupBy(*keys, "track", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("w").alias("n"))
            .repartition(*keys, "track", "node"))
    part = Window.partitionBy(*keys, "track", "node", "feature")
    upto = part.orderBy("bin")
    hist = hist.withColumns({"gl": F.sum("g").over(upto), "n_left": F.sum("n").over(upto),
                             "ga": F.sum("g").over(part), "na": F.sum("n").over(part)})

    def score(g: Column, n: Column) -> Column:
        real = g.cast("double") * F.lit(UNIT)
        return real * real / (n.cast("double") + l2)
    gl, nl, ga, na = (F.col(c) for c in ("gl", "n_left", "ga", "na"))
    return (hist.where((nl >= min_leaf) & (na - nl >= min_leaf) & (na > nl))
            .withColumn("gain", score(gl, nl) + score(ga - gl, na - nl) - score(ga, na))
            .select(*keys, "track", "node", "feature", "bin", "n_left", "gain"))


def _of(tracks: list[Track], name: str, kind: str) -> Column:
    """The growth parameter ``name`` of the row's track."""
    return F.get(F.array(*[F.lit(getattr(t.growth, name)).cast(kind) for t in tracks]), F.col("track"))


def _grown(splits: DataFrame, keys: list[str], tracks: list[Track]) -> DataFrame:
    """Per series the trees so far as an array over tracks of (f, b), each an array over heap places."""
    size = (1 << max(t.growth.depth for t in tracks)) - 1

    def over(c: str) -> Column:
        return F.expr(f"transform(sequence(1, {size}), n -> try_element_at(_m, n).{c})")
    one = (splits.groupBy(*keys, "track").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "bin")))).alias("_m"))
           .select(*keys, "track", F.struct(over("feature").alias("f"), over("bin").alias("b")).alias("t")))
    return (one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("track", "t"))).alias("_m"))
            .select(*keys, F.expr(f"transform(sequence(0, {len(tracks) - 1}), k -> try_element_at(_m, k))").alias("_trees")))


def _grow(rows: DataFrame, keys: list[str], tracks: list[Track], seed: int, row: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Grow the trees of a round level by level: (splits, leaves)."""
    splits, grown = None, None
    for level in range(max(t.growth.depth for t in tracks)):
        deep = [k for k, t in enumerate(tracks) if t.growth.depth > level]
        nodes = _nodes(rows, grown, keys, tracks, seed, row).where(
            (F.col("node") >= 1 << level) & F.col("track").isin(deep))
        found = candidates(nodes, keys, _of(tracks, "l2", "double"), _of(tracks, "min_leaf", "long"))
        if any(t.growth.columns < 1 for t in tracks):
            tree = F.get(F.array(*[F.lit(f"{t.model}:{t.tree}") for t in tracks]), F.col("track"))
            place = F.when(_of(tracks, "forest", "boolean"), F.col("node")).otherwise(F.lit(0))
            found = found.where(_draw(F.lit(seed), tree, place, "feature") < _of(tracks, "columns", "double"))
        found = found.where(F.col("gain") > F.greatest(_of(tracks, "min_gain", "double"), F.lit(1e-9)))
        best = found.groupBy(*keys, "track", "node").agg(F.max(F.struct(
            "gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("_best")).select(
            *keys, "track", "node", (-F.col("_best.f")).alias("feature"), (-F.col("_best.b")).alias("bin"), F.col("_best.gain").alias("gain"))
        if any(t.growth.leaves for t in tracks):
            rank = F.row_number().over(Window.partitionBy(*keys, "track").orderBy(F.desc("gain"), "node"))
            had = (splits.groupBy(*keys, "track").agg(F.count(F.lit(1)).alias("_had")) if splits is not None else None)
            best = best.withColumn("_rank", rank)
            best = best.withColumn("_had", F.lit(0)) if had is None else join_stats(best, had, [*keys, "track"])
            limit = F.coalesce(_of(tracks, "leaves", "int"), F.lit(1 << 30))
            best = best.where(F.col("_rank") + F.coalesce("_had", F.lit(0)) < limit).drop("_rank", "_had")
        best = cut_lineage(best)
        splits = best if splits is None else splits.unionByName(best)
        grown = _grown(splits, keys, tracks)
    rate = F.get(F.array(*[F.lit(1.0 / t.growth.trees if t.growth.forest else t.growth.rate) for t in tracks]), F.col("track"))
    leaves = (_nodes(rows, grown, keys, tracks, seed, row).groupBy(*keys, "track", "node").agg(F.sum("g").alias("g"), F.sum("w").alias("n"))
              .select(*keys, "track", "node", (rate * F.col("g").cast("double") * F.lit(UNIT)
                                                / (F.col("n").cast("double") + _of(tracks, "l2", "double"))).alias("value")))
    return splits, leaves


def _trees(splits: DataFrame | None, leaves: DataFrame, keys: list[str], tracks: list[Track]) -> DataFrame:
    """keys, model, tree, t: struct (f, b, v) of arrays over heap places; ``v`` holds the leaves' values."""
    parts = leaves.select(*keys, "track", "node", "value", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin"))
    if splits is not None:
        parts = parts.unionByName(splits.select(*keys, "track", "node", F.lit(None).cast("double").alias("value"), "feature", "bin"))
    size = (2 << max(t.growth.depth for t in tracks)) - 1
    # A place is a leaf or a split, never both, so it has one entry.
    one = parts.groupBy(*keys, "track").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "bin", "value")))).alias("_m"),
                                            F.max("node").alias("_top"))

    def over(c: str) -> Column:
        return F.expr(f"transform(sequence(1, least(_top, {size})), n -> try_element_at(_m, n).{c})")
    name = F.get(F.array(*[F.lit(t.model) for t in tracks]), F.col("track"))
    tree = F.get(F.array(*[F.lit(t.tree) for t in tracks]), F.col("track"))
    return one.select(*keys, name.alias("model"), tree.alias("tree"),
                      F.struct(over("feature").alias("f"), over("bin").alias("b"), over("value").alias("v")).alias("t"))


def prepare(rows: DataFrame, keys: list[str], features: list[str], label: str, row: list[str], bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Rows with bins ``b`` and label ``y`` (whole UNITs), and the series' edges."""
    rows = rows.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    ends = edges(rows, keys, features, bins)
    x = rows.select(*dict.fromkeys([*keys, *row]), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"),
                    F.round(F.col(label) / F.lit(UNIT)).cast("long").alias("y"))
    return join_stats(x, ends, keys).withColumn("b", F.expr(binned("_x", bins))).drop("_x", "lo", "width"), ends


def fit(rows: DataFrame, keys: list[str], row: list[str], features: list[str], label: str,
        families: dict[str, Growth] = FAMILIES, *, bins: int = BINS, seed: int = SEARCH_SEED) -> DataFrame:
    """One model per series and family: keys, model, base, trees (array of f, b, v), lo, width, depth.

    ``row`` names the columns that tell the rows of a series apart; draws depend on them and the seed alone.
    """
    # read several times, so worked out once
    rows = cut_lineage(rows.select(*dict.fromkeys([*keys, *row, *features, label, *(["_fold"] if "_fold" in rows.columns else [])])))
    data, ends = prepare(rows, keys, features, label, [*row, *(["_fold"] if any(g.skip is not None for g in families.values()) else [])], bins)
    ends = cut_lineage(ends)
    boosted = [m for m, g in families.items() if not g.forest]

    def start(g: Growth) -> Column:
        if g.forest:
            return F.lit(0.0)
        used = F.col("y") if g.skip is None else F.when(F.col("_fold") != g.skip, F.col("y"))
        return F.coalesce(F.round(F.sum(used).cast("double") / F.count(used)), F.lit(0.0))
    base = cut_lineage(data.groupBy(*keys).agg(*[start(g).alias(f"_b{k}") for k, g in enumerate(families.values())]))
    places = [list(families).index(m) for m in boosted]
    first = base.select(*keys, F.array(*[F.col(f"_b{k}") for k in places]).cast("array<double>").alias("_p"))
    data = cut_lineage(join_stats(data, first, keys))
    made = []
    for r in range(max(1 if g.forest else g.trees for g in families.values())):
        tracks = [Track(m, k, g) for m, g in families.items() if g.forest and r == 0 for k in range(g.trees)]
        tracks += [Track(m, r, families[m], j) for j, m in enumerate(boosted) if r < families[m].trees]
        splits, leaves = _grow(data, keys, tracks, seed, row)
        trees = cut_lineage(_trees(splits, leaves, keys, tracks))
        made.append(trees)
        later = [m for m in boosted if r + 1 < families[m].trees]
        if later:
            depth = max(families[m].depth for m in later)
            step = trees.where(F.col("model").isin(later)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", "t"))).alias("_m"))
            step = step.select(*keys, F.array(*[F.try_element_at("_m", F.lit(m)) for m in boosted]).alias("_t"))
            data = join_stats(data, step, keys).withColumn("_p", F.expr(
                f"transform(_p, (p, j) -> CASE WHEN _t[j] IS NULL THEN p ELSE p + {_value('_t[j]', 'b', depth)} / {UNIT!r}D END)"))
            data = cut_lineage(data.drop("_t"))
    every = reduce(DataFrame.unionByName, made)
    models = every.groupBy(*keys, "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "t"))), lambda e: e["t"]).alias("trees"))
    at = F.array_position(F.array(*[F.lit(m) for m in families]), F.col("model")).cast("int") - 1
    begin = F.get(F.array(*[F.col(f"_b{k}") for k in range(len(families))]), at) * F.lit(UNIT)
    depth = F.get(F.array(*[F.lit(g.depth) for g in families.values()]), at)
    return join_stats(join_stats(models, base, keys), ends, keys).select(
        *keys, "model", begin.alias("base"), "trees", "lo", "width", depth.alias("depth"))


def _value(tree: str, x: str, depth: int | str) -> str:
    """SQL text: the value of the leaf where a row ends; 0 in a leaf that no training row reached."""
    return f"coalesce(try_element_at({tree}.v, {walk(tree, x, depth)}), 0.0D)"


def predicted(x: str, bins: int = BINS) -> str:
    """SQL text: a model row's prediction (base, trees, lo, width, depth) for the feature array ``x``."""
    return (f"element_at(transform(array({binned(x, bins)}), q -> aggregate(trees, base, (s, t) -> s + {_value('t', 'q', 'depth')})), 1)")


def predict(rows: DataFrame, models: DataFrame, keys: list[str], features: list[str], bins: int = BINS) -> DataFrame:
    """Every row with every model of its series: the row's columns, model, prediction."""
    m = models.select(*keys, "model", "base", "trees", "lo", "width", "depth")
    joined = join_stats(rows.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features])), m, keys)
    return joined.withColumn("prediction", F.expr(predicted("_x", bins))).drop("_x", "base", "trees", "lo", "width", "depth")


def split_gains(rows: DataFrame, keys: list[str], features: list[str], label: str, growth: Growth, bins: int = BINS) -> DataFrame:
    """The best first split of every feature of a boosted tree: keys, feature (its name), bin, n_left, gain."""
    data, _ = prepare(rows, keys, features, label, [], bins)
    mean = data.groupBy(*keys).agg(F.round(F.sum("y").cast("double") / F.count("y")).cast("long").alias("_m"))
    nodes = join_stats(data, mean, keys).select(*keys, "b", F.lit(0).alias("track"), F.lit(1).alias("node"),
                                                (F.col("y") - F.col("_m")).alias("g"), F.lit(1).alias("w"))
    found = candidates(nodes, keys, F.lit(growth.l2), F.lit(growth.min_leaf))
    best = found.groupBy(*keys, "feature").agg(F.max(F.struct("gain", (-F.col("bin")).alias("b"), "n_left")).alias("_best"))
    return best.select(*keys, F.get(F.array(*[F.lit(f) for f in features]), F.col("feature")).alias("feature"),
                       (-F.col("_best.b")).alias("bin"), F.col("_best.n_left").alias("n_left"), F.col("_best.gain").alias("gain"))


def folds(rows: DataFrame, keys: list[str], ts: str, k: int) -> DataFrame:
    """Column ``_fold``: unshuffled folds of each series, the first ones a row longer where they do not divide evenly."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = rows.withColumns({"_i": i, "_n": n})
    return marked.withColumn("_fold", F.expr(
        f"CAST(CASE WHEN _i < (_n % {k}) * (_n div {k} + 1) THEN _i div (_n div {k} + 1) "
        f"ELSE _n % {k} + (_i - (_n % {k}) * (_n div {k} + 1)) div greatest(_n div {k}, 1) END AS INT)")).drop("_i", "_n")


def r_squared(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """R^2 per key of (actual, predicted); null where the actual values are constant."""
    spread = F.var_pop("actual") * F.count("actual")
    off = F.col("actual") - F.col("predicted")
    return pairs.groupBy(*keys).agg(F.when(spread > 0, 1 - F.sum(off * off) / spread).alias("r2"))


def search(rows: DataFrame, keys: list[str], ts: str, features: list[str], label: str, draws: dict[str, list[Growth]],
           k: int = 5, *, bins: int = BINS, seed: int = SEARCH_SEED) -> DataFrame:
    """Per series and family the draw with the best mean R^2 over unshuffled folds: keys, family, draw, r2, is_best.

    Every draw of every family on every fold is a model of one ``fit``: they grow in the same
    grouped sums, so the number of jobs is that of the longest model alone.
    """
    named = {f"{family}/{d}/{fold}": Growth(**{**g.__dict__, "skip": fold})
             for family, gs in draws.items() for d, g in enumerate(gs) for fold in range(k)}
    marked = cut_lineage(folds(rows.select(*keys, ts, *features, label), keys, ts, k))
    models = fit(marked, keys, [ts], features, label, named, bins=bins, seed=seed)
    part = F.split("model", "/")
    models = models.withColumn("_held", part[2].cast("int"))
    held = predict(marked.withColumnRenamed("_fold", "_held"), models, [*keys, "_held"], features, bins)
    scores = r_squared(held.select(*keys, "model", F.col(label).alias("actual"), F.col("prediction").alias("predicted")), [*keys, "model"])
    mean = scores.groupBy(*keys, part[0].alias("family"), part[1].cast("int").alias("draw")).agg(F.avg("r2").alias("r2"))
    rank = F.row_number().over(Window.partitionBy(*keys, "family").orderBy(F.desc_nulls_last("r2"), "draw"))
    return mean.withColumn("is_best", rank == 1)


def train(rows: DataFrame, keys: list[str], ts: str, features: list[str], label: str, families: dict[str, Growth] = FAMILIES,
          *, bins: int = BINS, seed: int = SEARCH_SEED) -> tuple[DataFrame, DataFrame]:
    """M11 per series: fit every family on the rows marked ``is_train``, score the others (A5), mark the smallest MAE.

    Returns the errors (keys, model, metrics, is_best) and each series' best model, ready to ``predict``.
    """
    models = cut_lineage(fit(rows.where("is_train"), keys, [ts], features, label, families, bins=bins, seed=seed))
    order = F.array_position(F.array(*[F.lit(m) for m in families]), F.col("model"))
    pairs = predict(rows.where("NOT is_train"), models, keys, features, bins).where("model IS NOT NULL")
    errors = E.metrics(pairs.select(*keys, "model", F.col(label).alias("actual"), F.col("prediction").alias("predicted")), [*keys, "model"])
    errors = errors.withColumn("family_order", order)
    top = E.best(errors, keys, order="family_order").select(*keys, "model").withColumn("is_best", F.lit(True))
    errors = cut_lineage(errors.join(top, [*keys, "model"], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False))).drop("family_order"))
    return errors, models.join(errors.where("is_best").select(*keys, "model"), [*keys, "model"], "left_semi")
