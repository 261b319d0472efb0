"""Size-checked joins: equi-joins on position bins or keys, with a shuffled form beyond the broadcast bound."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.intervals import bin_of, bins_of, overlaps, split_by_bin

# A side is broadcast only when counted to hold at most this many narrow rows (some tens of MB).
BROADCAST_ROWS = 250_000
# Copies of the lookup side in the shuffled keyed join; a hot key is spread over this many tasks.
SALTS = 32
# Widths of interval cells; the widest is 16 ** (LEVELS - 2) bins.
LEVELS = 7


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` is counted to have at most ``limit`` rows; the count stops just beyond it."""
    return df.limit(limit + 1).count() <= limit


def keyed_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", small: bool | None = None
) -> DataFrame:
    """Join ``left`` to a lookup table. ``how`` is inner, left, left_semi or left_anti.

    ``small`` says what is known of the lookup: True (counted to fit) broadcasts it. False, for a lookup with unique
    keys, spreads each key over salts, so that a key holding much of ``left`` does not land in one task. None leaves it
    to Spark, which measures the shuffled sizes at run time and splits skewed partitions of either side; it suits
    lookups with repeated keys or that would cost much to count.
    """
    if small is None:
        return left.join(right, on, how)
    if small:
        return left.join(F.broadcast(right), on, how)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_left.join(salted_right.hint("merge"), [*on, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class IntervalSet:
    """Target intervals ``contig, t_start, t_end`` with the counted number of their join rows.

    The count decides once how every join with them runs: broadcast up to the limit, sort-merge (which AQE can split
    where a cell is skewed) beyond it. Cells come in widths of a sixteenth of a bin, a bin, and powers of 16 bins. An
    interval is stored on one level only, the finest on which it is at most two cells long, so it makes at most three
    rows however long it is, and no cell is crowded with intervals much shorter than itself. ``levels`` are those in
    use; ``touched`` are upper bounds of the cells touched at widths of 1, 16, 256, ... bins.
    """

    intervals: DataFrame
    bin_size: int
    rows: int
    levels: tuple[int, ...]
    touched: tuple[int, ...]
    limit: int

    @property
    def small(self) -> bool:
        return self.rows <= self.limit

    def bins(self) -> DataFrame:
        """One row per interval and touched bin, with the part ``lo``..``hi`` of the interval in the bin."""
        spans = self.intervals.select("*", F.col("t_start").alias("start"), F.col("t_end").alias("end"))
        return split_by_bin(spans, self.bin_size).withColumnsRenamed({"start": "lo", "end": "hi"})

    def cells(self) -> DataFrame:
        """The intervals spread over their cells, as a join side hinted by the counted size."""
        return self.hinted(_spread(self.intervals.where("t_start < t_end"), "t_start", "t_end", self.bin_size))

    def hinted(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the intervals, at most three for each, as a join side."""
        return F.broadcast(rows) if self.small else rows.hint("merge")

    def to_cells(self, pieces: DataFrame) -> DataFrame:
        """Pieces (``bin, start, end``) with ``level`` and ``cell`` of each level in use, cut to the finest one's cells."""
        wide = [_cell(k, bin_of("bin", 16 ** (k - 1))) for k in self.levels if k]
        if 0 not in self.levels:
            return pieces.selectExpr("*", f"inline(array({', '.join(wide)}))" if wide else "inline(array(named_struct('level', 1, 'cell', bin)))")
        fine = width_of(0, self.bin_size)
        first, last = bin_of("start", fine), bin_of("`end` - 1", fine)
        one = f"array({', '.join([*wide, _cell(0, first)])})"
        many = f"transform(sequence({first}, {last}), c -> {_cell(0, 'c')})"
        many = f"concat(array({', '.join(wide)}), {many})" if wide else many
        spread = pieces.selectExpr("*", f"inline(IF({first} = {last}, {one}, {many}))")
        return spread.withColumns(
            {
                "start": F.expr(f"IF(level = 0, greatest(start, cell * {fine}L), start)"),
                "end": F.expr(f"IF(level = 0, least(`end`, (cell + 1) * {fine}L), `end`)"),
            }
        )


def width_of(level: int, bin_size: int) -> int:
    """Positions of a cell: a sixteenth of a bin on level 0, a bin on level 1, then 16 times the last."""
    return bin_size * 16 ** (level - 1) if level else max(bin_size // 16, 1)


def level_of(start: str, end: str, bin_size: int) -> str:
    """SQL of the finest level on which an interval is at most two cells long."""
    steps = " ".join(f"WHEN {end} - {start} <= {2 * width_of(k, bin_size)}L THEN {k}" for k in range(LEVELS - 1))
    return f"(CASE {steps} ELSE {LEVELS - 1} END)"


def _spread(intervals: DataFrame, start: str, end: str, bin_size: int, above: tuple[int, ...] = ()) -> DataFrame:
    """Add ``level`` and ``cell``: one row per cell of the interval's own level, and of those of ``above`` that are higher."""
    width = "element_at(array(" + ", ".join(f"{width_of(k, bin_size)}L" for k in range(LEVELS)) + "), level + 1)"
    levelled = intervals.withColumn("level", F.expr(level_of(start, end, bin_size)))
    if above:
        higher = F.filter(F.array(*[F.lit(k) for k in above]), lambda k: k > F.col("level"))
        levelled = levelled.withColumn("level", F.explode(F.array_append(higher, F.col("level"))))
    first, last = (f"(({pos}) - pmod({pos}, {width})) div {width}" for pos in (start, f"{end} - 1"))
    return levelled.selectExpr("*", f"explode(sequence({first}, {last})) AS cell")


def _cell(level: int, cell: str) -> str:
    return f"named_struct('level', {level}, 'cell', {cell})"


def interval_set(intervals: DataFrame, bin_size: int, limit: int | None = None) -> IntervalSet:
    """Count the join rows of ``contig, t_start, t_end`` intervals without making them."""
    return _counted(intervals, intervals, "t_start", "t_end", bin_size, limit)


def target_places(
    targets: DataFrame, bin_size: int, limit: int | None = None, counted: DataFrame | None = None
) -> IntervalSet:
    """The distinct places of targets (``contig, start, end``): copies of a target are measured once.

    The rows are counted before the distinct, an upper bound that needs no shuffle; ``counted`` may name a cheaper
    superset to count. A set that is ``small`` therefore has few targets as well. Targets without length or coordinates
    have no place (``target_rejects`` tells which).
    """
    places = targets.where("start < `end`").select("contig", F.col("start").alias("t_start"), F.col("end").alias("t_end")).distinct()
    return _counted(places, targets if counted is None else counted, "start", "`end`", bin_size, limit)


def _counted(
    intervals: DataFrame, counted: DataFrame, start: str, end: str, bin_size: int, limit: int | None
) -> IntervalSet:
    usable = counted.where(f"{start} < {end}").withColumn("_level", F.expr(level_of(start, end, bin_size)))
    widths = [bin_size * 16**k for k in range(LEVELS - 1)]
    touched = [f"coalesce(sum({bin_of(f'{end} - 1', w)} - {bin_of(start, w)} + 1), 0L) AS w{i}" for i, w in enumerate(widths)]
    row = usable.selectExpr("count(*) AS n", *[f"count(IF(_level = {k}, 1, NULL)) AS n{k}" for k in range(LEVELS)], *touched).first()
    # an interval of two cells' length touches at most three; the widest level has no bound but that of all positions
    rows = 3 * (row.n - row[f"n{LEVELS - 1}"]) + (row[f"w{LEVELS - 2}"] if row[f"n{LEVELS - 1}"] else 0)
    levels = tuple(k for k in range(LEVELS) if row[f"n{k}"])
    limit = BROADCAST_ROWS if limit is None else limit
    return IntervalSet(intervals, bin_size, rows, levels, tuple(row[f"w{i}"] for i in range(len(widths))), limit)


def target_rejects(targets: DataFrame) -> DataFrame:
    """The targets that cannot be measured, with the ``reason``."""
    reason = F.when(
        F.col("contig").isNull() | F.col("start").isNull() | F.col("end").isNull(), "no coordinates"
    ).when(F.col("start") >= F.col("end"), "start >= end")
    return targets.withColumn("reason", reason).where(F.col("reason").isNotNull())


def interval_join(pieces: DataFrame, targets: IntervalSet) -> DataFrame:
    """Overlap join of bin-cut pieces (``contig, bin, start, end, ...``) with target intervals.

    Every overlapping interval receives the piece, clipped to it; ``lo`` and ``hi`` bound the interval in the piece's
    bin. A piece may come in several adjoining parts, and no position of it comes twice.
    """
    size = targets.bin_size
    kept = [f"p.{c}" for c in pieces.columns if c not in ("start", "end")]
    extra = [f"t.{c}" for c in targets.intervals.columns if c != "contig"]
    met = F.expr(
        "p.contig = t.contig AND p.level = t.level AND p.cell = t.cell AND p.start < t.t_end AND p.`end` > t.t_start"
    )
    return targets.to_cells(pieces).alias("p").join(targets.cells().alias("t"), met).selectExpr(
        *kept, "greatest(p.start, t.t_start) AS start", "least(p.`end`, t.t_end) AS `end`", *extra,
        f"greatest(t.t_start, p.bin * {size}L) AS lo", f"least(t.t_end, (p.bin + 1) * {size}L) AS hi",
    )


def point_interval_join(points: DataFrame, targets: IntervalSet) -> DataFrame:
    """Join positions (``contig, pos, ...``) to every interval with ``t_start <= pos < t_end``."""
    columns = points.columns
    spans = points.selectExpr("*", f"{bin_of('pos', targets.bin_size)} AS bin", "pos AS start", "pos + 1 AS `end`")
    extra = [c for c in targets.intervals.columns if c != "contig"]
    return (
        targets.to_cells(spans)
        .join(targets.cells(), ["contig", "level", "cell"])
        .where("pos >= t_start AND pos < t_end")
        .select(*columns, *extra)
    )


def span_join(left: DataFrame, targets: IntervalSet) -> DataFrame:
    """Overlap join of whole intervals, each pair once: ``contig, start, end, ...`` with the target intervals.

    Both are spread over the cells of their own level and of those above it, and meet on the higher of their levels, where
    both are short: some dozen rows for an interval of any length. A pair is kept only in the first cell they share, so
    no distinct is needed.
    """
    size = targets.bin_size
    width = "element_at(array(" + ", ".join(f"{width_of(k, size)}L" for k in range(LEVELS)) + "), level + 1)"
    spread = _spread(left.where("start < `end`"), "start", "`end`", size, targets.levels)
    other = targets.hinted(_spread(targets.intervals.where("t_start < t_end"), "t_start", "t_end", size, tuple(range(LEVELS))))
    first = "greatest(start, t_start)"
    return (
        spread.join(other, ["contig", "level", "cell"])
        .where(overlaps(F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end")))
        .where(f"level = greatest({level_of('start', '`end`', size)}, {level_of('t_start', 't_end', size)})")
        .where(f"cell = ({first} - pmod({first}, {width})) div {width}")
        .drop("level", "cell")
    )


def prune_to_intervals(pieces: DataFrame, targets: IntervalSet) -> DataFrame:
    """Drop pieces in bins no interval touches, before they reach a shuffle.

    The touched bins are broadcast, or stretches of 16, 256, ... bins where those of long or many targets are more than
    the limit.
    """
    power = next((k for k, n in enumerate(targets.touched) if n <= targets.limit), None)
    if power is None:  # many targets; where they crowd, their distinct cells are few
        bins = targets.bins().select("contig", "bin").distinct()
        counts = bins.agg(*[F.count_distinct("contig", F.expr(bin_of("bin", 16**k))).alias(f"w{k}") for k in range(LEVELS - 1)]).first()
        power = next((k for k in range(LEVELS - 1) if counts[f"w{k}"] <= targets.limit), None)
        if power is None:  # more contigs than the limit
            return pieces
    width = targets.bin_size * 16**power
    place = F.expr(bin_of("bin", 16**power)).alias("_wide")
    touched = targets.intervals.where("t_start < t_end").select("contig", bins_of("t_start", "t_end", width).alias("_wide")).distinct()
    return pieces.select("*", place).join(F.broadcast(touched), ["contig", "_wide"], "left_semi").drop("_wide")


def running_totals(df: DataFrame, chunks: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """Running sums over a whole table without a one-task window.

    ``totals`` maps a new column to the integer column it accumulates. Rows are ordered by ``chunks`` then ``order``.
    Sums per chunk are accumulated over the short chunk table, then added to the running sums within each chunk.
    """
    per_chunk = df.groupBy(*chunks).agg(*[F.sum(src).alias(dst) for dst, src in totals.items()])
    before = Window.orderBy(*chunks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *chunks, *[F.coalesce(F.sum(dst).over(before), F.lit(0)).alias(f"_before_{dst}") for dst in totals]
    )
    within = Window.partitionBy(*chunks).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = keyed_join(df, offsets, chunks)
    return joined.withColumns(
        {dst: F.col(f"_before_{dst}") + F.sum(src).over(within) for dst, src in totals.items()}
    ).drop(*[f"_before_{dst}" for dst in totals])


def chunk_of(number: str, size: int = 1 << 16) -> Column:
    """Chunk column for ``running_totals`` from a row number."""
    return F.expr(f"{number} div {size}L")
