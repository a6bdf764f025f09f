"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

from .batches import map_groups
from .graph import apart, components
from .vectors import as_doubles, by_dim, matrix, travels_as, units, usable

#: Bits of a sort key.
BITS = 60
#: Neighbours that a row is compared with in a pass over all rows, and in one over crowded rows.
REACH, CROWDED_REACH = 64, 4096
#: A cell of equal leading bits is crowded above so many times the reach.
CROWD = 4
#: Shares of isolated and of crowded pairs at the threshold that the passes may miss.
MISS, CROWDED_MISS = 0.002, 0.03
#: Members that a cell's centre is taken from.
MEMBERS = 64
#: Rows of a window block, and of a tile in which links are counted.
BLOCK, TILE = 4096, 2048


def agreement(least: float) -> float:
    """Chance that a random plane leaves two vectors of cosine ``least`` on one side."""
    return 1 - math.acos(least) / math.pi


def plan_passes(n: int, reach: int, least: float, miss: float, dense: bool = False) -> tuple[int, int]:
    """Leading bits that leave about ``reach`` of ``n`` rows, and passes after which a pair is missed with probability ``miss``.

    A pair stays together in a pass while it agrees in every halving. Among
    ``dense`` rows halvings have to be taken about the rows' own mean: there
    a pair at the threshold is seen under 60 degrees, if the others are at a cosine of
    0.9 of each other, and two of three planes leave it on one side.
    """
    bits = max(0, math.ceil(math.log2(max(1.0, n / reach))))
    stays = agreement(least) ** bits
    if dense:
        # planes through the origin leave more than half of a dense group in a cell; the rest is halved about its mean
        within = max(0, math.ceil(math.log2(max(1.0, n * 0.86**bits / reach))))
        stays *= (2 / 3) ** within
    return bits, 1 if bits == 0 else max(4, math.ceil(math.log(miss) / math.log1p(-stays)))


@lru_cache(maxsize=64)
def _planes(dim: int, turn: int, salt: int) -> np.ndarray:
    return np.random.default_rng([20240405, dim, turn, salt]).normal(size=(dim, BITS))


def sort_keys(x: np.ndarray, turn: int, salt: int = 0) -> np.ndarray:
    """The signs of random projections, concatenated: comparing the numbers compares the bits from the first on."""
    bits = x @ _planes(x.shape[1], turn, salt) >= 0
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class _Forest:
    """Labels of the rows of a block; of the links given row by row, those that join parts that were apart are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joins(self, ends: np.ndarray, own: int) -> np.ndarray:
        """Which of ``ends`` the row ``own`` needs to be linked to."""
        parts, first = np.unique(self.label[ends], return_index=True)
        mine = self.label[own]
        first = first[parts != mine]
        if len(first):
            parts = np.append(parts, mine)
            self.label[np.isin(self.label, parts)] = parts.min()
        return ends[first]


def _window_links(reach: int, least: float):
    """Compare every row of a block with the next ``reach`` in order, in bands; a spanning set of the verified links."""

    def fn(table: pa.Table) -> pa.RecordBatch:
        order = np.argsort(table["rank"].to_numpy(), kind="stable")
        ids, own = (table[c].to_numpy(zero_copy_only=False)[order] for c in ("id", "own"))
        x = units(table["vec"])[order]
        forest, a, b = _Forest(len(x)), [], []
        band, last = min(512, max(128, reach)), int(own.sum())
        for lo in range(0, last, band):
            hi = min(lo + band, last)
            rows, cols = np.nonzero(x[lo:hi] @ x[lo : hi + reach].T >= least)
            near = (cols > rows) & (cols - rows <= reach)
            rows, cols = rows[near] + lo, cols[near] + lo
            at = np.flatnonzero(np.diff(rows, prepend=-1))
            for row, ends in zip(rows[at].tolist(), np.split(cols, at[1:])):
                ends = forest.joins(ends, row)
                a.append(np.full(len(ends), ids[row]))
                b.append(ids[ends])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return fn


def _count_links(least: float):
    """For two tiles of a component: how many vectors of the other (or the same) tile each vector links with, copies counted."""

    def fn(table: pa.Table) -> pa.RecordBatch:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        ids, tile, copies = (table[c].to_numpy() for c in ("rep", "tile", "copies"))
        x = units(table["vec"])
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        near = x[left] @ x[right].T >= least
        if i == j:
            np.fill_diagonal(near, False)
            return pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(near @ copies[right])], names=["rep", "n"])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[left], ids[right]])), pa.array(np.concatenate([near @ copies[right], copies[left] @ near]))], names=["rep", "n"])

    return fn


def _means(reps: DataFrame) -> dict[int, np.ndarray]:
    """Mean direction of the vectors of each length: as many numbers as a vector has."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at in by_dim(batch).items():
                total[dim] = total.get(dim, np.zeros(dim)) + units(batch.column("vec").take(pa.array(at))).sum(0)
        for dim, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int64)), pa.array(np.arange(dim)), pa.array(s)], names=["dim", "place", "s"])

    sums = reps.select("dim", "vec").mapInArrow(run, "dim long, place long, s double").groupBy("dim", "place").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    counts = dict(map(tuple, reps.groupBy("dim").agg(F.count(F.lit(1))).collect()))
    for dim, place, s in sums.collect():
        out.setdefault(dim, np.zeros(dim))[place] = s / counts[dim]
    return out


def _keys(reps: DataFrame, plan: dict[int, tuple[int, int]], means: dict[int, np.ndarray], salt: int) -> DataFrame:
    """Sort keys of all passes: ``(turn, cell, key, rep)``; ``turn`` names vector length and pass, ``cell`` is the leading bits."""

    def run(batches):
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            for dim, at in by_dim(batch).items():
                bits, turns = plan[dim]
                x = units(batch.column("vec").take(pa.array(at))) - means[dim]
                for turn in range(turns):
                    key = sort_keys(x, turn, salt)
                    columns = [np.full(len(at), turn * 1_000_000 + dim, np.int64), key >> (BITS - bits), key, rep[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["turn", "cell", "key", "rep"])

    return cut_lineage(reps.select("dim", "rep", "vec").mapInArrow(run, "turn long, cell long, key long, rep long"))


def _recentred(keys: DataFrame, reps: DataFrame, limit: int) -> DataFrame:
    """Keys of rows in cells above ``limit`` rows, taken anew about the cell's own mean (of MEMBERS rows chosen by hash)."""
    cells = cut_lineage(keys.groupBy("turn", "cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(F.col("turn").alias("_turn"), F.col("cell").alias("_cell")))
    if cells.isEmpty():
        return keys
    same = (F.col("turn") == F.col("_turn")) & (F.col("cell") == F.col("_cell"))
    large = cut_lineage(keys.join(cells, same, "left_semi"))
    few = Window.partitionBy("turn", "cell").orderBy(F.xxhash64("rep"), "rep")
    members = large.withColumn("_r", F.row_number().over(few)).filter(F.col("_r") <= MEMBERS).select("turn", "cell", "rep")

    def mean(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(table[c].slice(0, 1).combine_chunks() for c in ("turn", "cell")), pa.array([units(table["vec"]).mean(0)])], names=["_turn", "_cell", "_centre"])

    centres = cut_lineage(map_groups(members.join(reps.select("rep", "vec"), "rep"), ["turn", "cell"], mean, "_turn long, _cell long, _centre array<double>"))

    def anew(batches):
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            for turn in np.unique(turns).tolist():
                at = pa.array(np.flatnonzero(turns == turn))
                part = batch.take(at)
                x = units(part.column("vec")) - matrix(part.column("_centre"), turn % 1_000_000)
                yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("cell"), pa.array(sort_keys(x, turn // 1_000_000, 2)), part.column("rep")], names=["turn", "cell", "key", "rep"])

    wide = large.join(reps.select("rep", "vec"), "rep").join(centres, same).select("turn", "cell", "rep", "vec", "_centre")
    return keys.join(cells, same, "left_anti").unionByName(wide.mapInArrow(anew, "turn long, cell long, key long, rep long"))


def _pass_links(keys: DataFrame, reps: DataFrame, reach: int, least: float) -> DataFrame:
    """Links ``(a, b)`` between rows at most ``reach`` places apart in the order of a pass. Only keys are sorted; vectors join their places."""
    order = ["turn", "cell", "key", "rep"]
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ordered = cut_lineage(ordered.select("turn", "rep", F.monotonically_increasing_id().alias("_at")))
    numbered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    parts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    numbered = numbered.join(parts, "_part").select("turn", "rep", (F.col("_base") + F.col("_at")).alias("rank"))
    numbered = numbered.join(reps.select("rep", "id", "vec"), "rep")
    block, size = F.expr(f"rank div {BLOCK}"), -(-reach // BLOCK)
    columns = ["block", "rank", "turn", "id", "vec", "own"]
    dealt = numbered.withColumn("own", F.lit(True)).withColumn("block", block).select(*columns)
    # a row is also compared by the blocks before it from which it can be reached
    ahead = numbered.withColumn("own", F.lit(False)).withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(size)))).withColumn("block", block - F.col("_back"))
    ahead = ahead.filter((F.col("rank") - (F.col("block") + 1) * BLOCK < reach) & (F.col("block") >= 0)).select(*columns)
    return map_groups(dealt.unionByName(ahead), ["turn", "block"], _window_links(reach, least), "a long, b long")


def _crowded(keys: DataFrame, reps: DataFrame, limit: int) -> DataFrame:
    """Vectors that are in a cell above ``limit`` rows in any pass."""
    cells = cut_lineage(keys.groupBy("turn", "cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("turn", "cell"))
    return cut_lineage(reps.join(keys.join(cells, ["turn", "cell"], "left_semi").select("rep").distinct(), "rep", "left_semi"))


def _sizes(reps: DataFrame) -> dict[int, int]:
    return dict(map(tuple, reps.groupBy("dim").agg(F.count(F.lit(1))).collect()))


def find_links(reps: DataFrame, least: float, reach: int = REACH, crowded_reach: int = CROWDED_REACH) -> DataFrame:
    """A spanning set of the links ``(a, b)`` of ids that the passes over distinct vectors ``(rep, id, dim, vec)`` find."""
    plan = {d: plan_passes(n, reach, least, MISS) for d, n in _sizes(reps).items()}
    keys = _keys(reps, plan, _means(reps), 0)
    links = cut_lineage(_pass_links(keys, reps, reach, least))
    dense = _crowded(keys, reps, CROWD * reach)
    sizes = _sizes(dense)
    if not sizes:
        return links
    plan = {d: plan_passes(n, crowded_reach, least, CROWDED_MISS, dense=True) for d, n in sizes.items()}
    keys = cut_lineage(_recentred(_keys(dense, plan, _means(dense), 1), dense, crowded_reach))
    return links.unionByName(cut_lineage(_pass_links(keys, dense, crowded_reach, least)))


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.95, reach: int = REACH, crowded_reach: int = CROWDED_REACH) -> DataFrame:
    """Link vectors of cosine ``least`` or more: ``(id, n_links, component_id, kept)``, one row for each input row.

    ``n_links`` counts the other vectors linked directly, ``component_id`` is the
    smallest id reachable, ``kept`` whether that is the row's own. Vectors that are
    null, empty, zero or hold null or non-finite components have no links and are
    their own component; a null id has none and is not kept. Vectors of other
    lengths never link, but rows of one id share its component. Equal vectors are one node from the start, so repeated
    rows (of one id, too) link with each other. An empty table gives none; extra
    columns are not read.

    Method. In each pass the distinct vectors are sorted by the concatenated signs
    of fresh random projections about their mean. Sorted rows are numbered and cut into blocks,
    each row is compared with the next ``reach`` in
    double precision, and the verified links of all passes are united. A block
    gives a spanning set of its links, so a large group costs rows and not pairs.
    ``plan_passes`` takes the number of passes from the number of rows. Where leading bits leave
    more than CROWD times ``reach`` rows in a cell, as in a dense cone or a large group of near copies,
    its vectors go through passes of their own: cells that are still large are
    sorted by projections about their own mean, and windows have ``crowded_reach`` rows.
    The links inside a component are then counted exactly, tile against tile,
    which also finds those that no window held; the counts are added up and never
    listed. A pair is missed only if no chain of windows joins it.
    """
    usable_rows = as_doubles(df, id, vector)
    reps = usable_rows.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    reps = cut_lineage(reps.withColumn("rep", F.monotonically_increasing_id()))
    thin = F.col("vec").cast(f"array<{travels_as(df, vector)}>").alias("vec")
    found = cut_lineage(components(find_links(reps.select("rep", "id", "dim", thin), least, reach, crowded_reach)))

    member = reps.join(found, F.col("id") == F.col("node")).select("dim", "rep", "vec", "copies", "component")
    sizes = member.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    member = member.join(apart(sizes, "component"), "component").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    tiles = member.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiles = tiles.select("component", "dim", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j"), "rep", "tile", "copies", thin)
    counted = map_groups(tiles, ["component", "dim", "i", "j"], _count_links(least), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    node = reps.join(counted, "rep", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    node = node.select(F.col("dim").alias("_dim"), F.col("vec").alias("_vec"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "id").alias("_component"))
    labelled = usable_rows.join(node, (F.col("dim") == F.col("_dim")) & (F.col("vec") == F.col("_vec"))).select(F.col("id"), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    rest = df.filter(~(F.col(id).isNotNull() & usable(F.col(vector)))).select(F.col(id).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id).cast("long").alias("component_id"))
    return labelled.unionByName(rest).select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at cosine 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
