"""Similarity joins and nearest neighbours, exact.

Term vectors meet on the keys they must share (see ``functions.vectors``).
Dense vectors meet in cells around pivots, so that only rows near enough to reach
the threshold are compared (see ``operators.nearest``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.operators import nearest as N
from tidewire.operators.greedy import MAX_DEPTH
from tidewire.operators.spread import LISTED, listed, spread_join
from tidewire.session import cut, cut_counted

# Texts may be long, so blocks of term vectors hold few rows.
CROWDED_ROWS = 512
# Products of two entries that are summed up at once.
PRODUCTS = 2_000_000
# Left sides of at most so many entries are handed to every task, and so many sums are held at once.
FEW_ENTRIES, SUMS = 1_000_000, 4_000_000
SCORE_DIGITS = N.SCORE_DIGITS
# A key's bounds are shuffled as two whole numbers of so many bits, side by side in one.
BITS = 15
SCALE = (1 << BITS) - 1
# Of the heads' slack, the share that pairs are formed within.
PAIR_SLACK = 0.25


# -- term vectors -----------------------------------------------------------


def _reach(threshold: float) -> float:
    """What two rows must still have in common from a key on for it to tell anything of the pair."""
    return threshold - min(V.HEAD_SLACK, threshold / 10) * PAIR_SLACK


def _rest(key: Column) -> Column:
    """Squared length of a row from a key of its own on."""
    w = key["w"].cast("double")
    return 1 - key["c"].cast("double") + w * w


def _near(threshold: float) -> Column:
    """The keys that may tell anything: those from which on a row alone is as long as ``_reach``."""
    least = _reach(threshold) ** 2 - V.ROUNDING
    return F.filter("keys", lambda k: _rest(k) >= least)


def _side(rows: DataFrame, p: str, threshold: float) -> DataFrame:
    """One row per near key of ``id, keys``: ``{p}id, key`` and ``{p}b``, its weight and the squared
    length from it on in one number, both rounded up, so that no pair's bound is too low."""
    k = F.col("_k")
    w, rest = (
        F.greatest(F.least(F.ceil(x * SCALE), F.lit(SCALE)), F.lit(0)).cast("int")
        for x in (k["w"].cast("double"), _rest(k) + V.ROUNDING)
    )
    return rows.select(F.col("id").alias(f"{p}id"), F.explode(_near(threshold)).alias("_k")).select(
        f"{p}id", k["k"].alias("key"), F.shiftleft(w, BITS).bitwiseOR(rest).alias(f"{p}b")
    )


def _weight(bounds: str) -> Column:
    return F.shiftright(bounds, BITS).cast("long")


def _length(bounds: str) -> Column:
    return F.col(bounds).bitwiseAND(F.lit(SCALE)).cast("long")


def _possible(joined: DataFrame, threshold: float) -> DataFrame:
    """Pairs that can still reach ``threshold`` given the keys they share.

    Both sides order their terms alike.  From the first shared term on from which the rows' lengths
    multiplied are below ``_reach``, they have less than that in common; the products of the shared terms
    before it, which are keys of both, are summed up.  So a pair is formed only where a key lies early
    in both rows, and refused if the sum isn't what is missing.  Where crowded
    keys were left out of the join, the lengths of what the sides have of them
    (``lq``, ``rq``) bound what those keys could add.
    """
    unknown = F.lit(0.0)
    lengths = [c for c in ("lq", "rq") if c in joined.columns]
    if lengths:
        unknown = F.col("lq") * F.col("rq")
    reach = _reach(threshold)
    return (
        joined.where(_length("lb") * _length("rb") >= int(reach**2 * SCALE**2))
        .groupBy("lid", "rid")
        .agg(F.sum(_weight("lb") * _weight("rb")).alias("s"), *[F.max(c).alias(c) for c in lengths])
        .where(F.col("s") / SCALE**2 + unknown >= threshold - reach - V.ROUNDING)
        .select("lid", "rid")
    )


def _quiet(keys: DataFrame, crowd: DataFrame, p: str) -> DataFrame:
    """A side's keys without the crowded ones, and the length of what each row has of those."""
    id_, w = f"{p}id", _weight(f"{p}b") / SCALE
    lengths = (
        keys.join(crowd.select("key"), "key", "left_semi").groupBy(id_).agg(F.sqrt(F.sum(w * w)).alias(f"{p}q"))
    )
    rest = keys.join(crowd.select("key"), "key", "left_anti").join(lengths, id_, "left")
    return rest.withColumn(f"{p}q", F.coalesce(f"{p}q", F.lit(0.0)))


def shared_keys(
    left: DataFrame, right: DataFrame, threshold: float, total: int, floor: int | None
) -> DataFrame:
    """Distinct ``(lid, rid)`` that share keys enough.  Inputs: ``id, keys``."""
    joined = spread_join(_side(left, "l", threshold), _side(right, "r", threshold), ["key"], "inner", "lid", total, floor)
    return _possible(joined, threshold)


def _paired(pairs: DataFrame, n: int, rows: DataFrame, own: str) -> DataFrame:
    """The rows that are in one of ``n`` pairs, under ``own``; no others are shuffled."""
    ids, most = pairs.select(own).distinct(), n
    if most > LISTED:
        ids, counted = cut_counted(ids, "paired")
        most = counted["rows"]
    return rows.withColumnRenamed("id", own).join(listed(ids, most), own, "left_semi")


def promising(
    pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, floor: int | None = None
) -> DataFrame:
    """Those of ``lid, rid`` that all their keys let reach ``threshold``.

    A row's keys are a small part of its vector, so most pairs that aren't similar go before vectors are
    shuffled.  Up to the last shared key the product is known; beyond it there is at most the tail of the
    side whose head ends first times what is left of the other.
    """
    pairs, found = cut_counted(pairs, "met")
    n = found["rows"]

    def heads(rows: DataFrame, own: str) -> DataFrame:
        def bounds(k: Column) -> Column:
            w, c = F.ceil(k["w"].cast("double") * SCALE), F.floor(k["c"].cast("double") * SCALE)
            w, c = (F.greatest(F.least(x, F.lit(SCALE)), F.lit(0)).cast("int") for x in (w, c))
            return F.shiftleft(w, BITS).bitwiseOR(c)

        p = own[0]
        return _paired(pairs, n, rows, own).select(
            own,
            F.col("keys.k").alias(f"{p}f"),
            F.transform("keys", bounds).alias(f"{p}b"),
            F.get("keys", F.lit(0))["r"].cast("double").alias(f"{p}r"),
        )

    def marked(p: str, side: int) -> Column:
        return F.transform(
            F.arrays_zip(F.col(f"{p}f").alias("f"), F.col(f"{p}b").alias("b")),
            lambda x: F.struct(x["f"].alias("f"), F.lit(side).alias("side"), x["b"].alias("b")),
        )

    wide = spread_join(pairs, heads(right, "rid"), ["rid"], "inner", "lid", n, floor)
    wide = spread_join(wide, heads(left, "lid"), ["lid"], "inner", "rid", n, floor)
    zero = F.lit(0).cast("long")

    def step(acc: Column, t: Column) -> Column:
        met = acc["f"] == t["f"]
        w = [F.shiftright(x["b"], BITS).cast("long") for x in (acc, t)]
        c = [x["b"].bitwiseAND(F.lit(SCALE)).cast("long") for x in (acc, t)]
        return F.struct(
            F.when(met, acc["s"] + w[0] * w[1]).otherwise(acc["s"]).alias("s"),
            F.when(met, F.greatest(acc["lc"], c[0])).otherwise(acc["lc"]).alias("lc"),
            F.when(met, F.greatest(acc["rc"], c[1])).otherwise(acc["rc"]).alias("rc"),
            t["f"].alias("f"),
            t["b"].alias("b"),
        )

    start = F.struct(
        zero.alias("s"), zero.alias("lc"), zero.alias("rc"), F.lit(-1).cast("long").alias("f"), F.lit(0).alias("b")
    )
    walked = wide.select(
        "lid", "rid", "lr", "rr",
        F.aggregate(F.sort_array(F.concat(marked("l", 0), marked("r", 1))), start, step).alias("m"),
    )

    def beyond(tail: str, other: str) -> Column:
        return F.col(tail) * F.sqrt(1 - F.col(f"m.{other}") / SCALE)

    bound = F.col("m.s") / SCALE**2 + F.greatest(beyond("lr", "rc"), beyond("rr", "lc"))
    return walked.where(bound >= threshold - V.ROUNDING).select("lid", "rid")


def score_pairs(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    floor: int | None = None,
) -> DataFrame:
    """``lid, rid, sim`` of the pairs at or above ``threshold``.

    The pairs are written first: their number decides whether a much-paired row
    has to be split.  Only vectors that are in a pair are shuffled.
    """
    pairs, found = cut_counted(pairs, "pairs")
    n = found["rows"]

    def vecs(rows: DataFrame, own: str) -> DataFrame:
        return _paired(pairs, n, rows.select("id", F.col("vec").alias(f"{own[0]}vec")), own)

    lv, rv = vecs(left, "lid"), vecs(right, "rid")
    wide = spread_join(pairs, rv, ["rid"], "inner", "lid", n, floor)
    wide = spread_join(wide, lv, ["lid"], "inner", "rid", n, floor)
    scored = V.with_dot(wide, "lvec", "rvec")
    return scored.where(F.col("sim") >= threshold).select("lid", "rid", "sim")


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    total: int = 0,
    floor: int | None = None,
    crowded: int = MAX_DEPTH,
    block: int = CROWDED_ROWS,
    few: int = FEW_ENTRIES,
) -> DataFrame:
    """All pairs at or above ``threshold``.  Inputs: ``id, vec, keys``.

    A left side of few entries goes to the right rows where they lie, which are not shuffled.  Else a
    key that more than ``crowded`` right rows share would pair each left row with all of them, so its
    rows are compared by blocks instead.
    """
    if (left.agg(F.sum(F.size("vec.f"))).first()[0] or 0) <= few:
        return pairs_beside(left, right, threshold)
    lk, rk = _side(left, "l", threshold), _side(right, "r", threshold)
    crowd, n = cut_counted(
        rk.select("key")
        .join(lk.select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > crowded),
        "crowd",
    )
    if not n["rows"]:
        pairs = promising(shared_keys(left, right, threshold, total, floor), left, right, threshold, floor)
        return score_pairs(pairs, left, right, threshold, floor)
    crowd = listed(crowd, n["rows"])
    quiet = spread_join(_quiet(lk, crowd, "l"), _quiet(rk, crowd, "r"), ["key"], "inner", "lid", total, floor)
    pairs = promising(_possible(quiet, threshold), left, right, threshold, floor)
    few = score_pairs(pairs, left, right, threshold, floor)
    many = crowded_pairs(
        lk.select("lid", "key"), rk.select("rid", "key"), crowd, left, right, threshold, block
    ).select("lid", "rid", "sim")
    return few.unionByName(many).groupBy("lid", "rid").agg(F.max("sim").alias("sim"))


def pairs_beside(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs at or above ``threshold``, the left side broadcast and the right one read once."""
    lkind, rkind = _id_types(left, right)
    held = left.select("id", "vec").toArrow().combine_chunks()
    ids, lists = held.column("id").combine_chunks(), _flat(held)
    shared = left.sparkSession.sparkContext.broadcast((ids, lists))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lid, lists = shared.value
        if not len(lid):
            return
        terms, rows = np.unique(lists[0]), max(1, SUMS // len(lid))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = pa.Table.from_batches([batch.slice(at, rows)])
                rid, (f, w, ends) = part.column("id").combine_chunks(), _flat(part)
                met = np.isin(f, terms)
                ends = np.concatenate([[0], np.cumsum(met)])[ends]
                for first, sims in _products((f[met], w[met], ends), lists):
                    i, j = np.nonzero(sims >= threshold)
                    yield pa.RecordBatch.from_arrays(
                        [lid.take(pa.array(j)), rid.take(pa.array(i + first)), pa.array(sims[i, j])], names=["lid", "rid", "sim"]
                    )

    rows = right.select("id", "vec").where(F.col("vec").isNotNull())
    return rows.mapInArrow(compare, f"lid {lkind}, rid {rkind}, sim double")


def term_finder(
    rows: DataFrame,
    threshold: float,
    floor: int | None = None,
    crowded_at: int = MAX_DEPTH,
    block: int = CROWDED_ROWS,
):
    """Conflict finder over term vectors for ``keep_first``.  ``rows``: ``seq, vec, keys``.

    The first rows of each key are picked with a row number, which Spark limits
    before the shuffle, so a key shared by many rows sends few.  At the depth
    ``crowded_at`` the keys that are still deeper go to ``crowded_pairs``.
    """
    byid = rows.select(F.col("seq").alias("id"), "vec", "keys")

    def find(live: DataFrame, depth: int, total: int) -> tuple[DataFrame, DataFrame]:
        keys = _side(live.select(F.col("seq").alias("id"), "keys"), "l", threshold)
        order = Window.partitionBy("key").orderBy("lid")
        first = (
            keys.withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= depth)
            .select("key", F.col("lid").alias("rid"), F.col("lb").alias("rb"))
        )
        shown = first.groupBy(F.col("rid").alias("seq")).agg(F.count("*").alias("_n"))
        incomplete = (
            live.select("seq", F.size(_near(threshold)).alias("_k"))
            .join(shown, "seq", "left")
            .where(F.col("_k") > F.coalesce(F.col("_n"), F.lit(0)))
            .select("seq")
        )
        crowd = None
        if depth >= crowded_at:
            crowd, n = cut_counted(
                keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > depth), "crowd"
            )
            crowd = listed(crowd, n["rows"]) if n["rows"] else None
        if crowd is None:
            joined = spread_join(keys, first, ["key"], "inner", "lid", total, floor)
            pairs = _possible(joined.where("rid < lid"), threshold)
            pairs = promising(pairs, byid, byid, threshold, floor)
            scored = cut(score_pairs(pairs, byid, byid, threshold, floor), "edges")
            edges = scored.select(F.col("lid").alias("seq"), F.col("rid").alias("earlier"))
            return edges, live.select("seq").join(incomplete, "seq", "left_anti")
        # Crowded keys by blocks, the others as before: what is not deeper than ``depth`` is
        # in ``first`` whole, so the lengths of the crowded keys alone are unknown.
        ours = _quiet(keys, crowd, "l")
        theirs = _quiet(keys.select("key", F.col("lid").alias("rid"), F.col("lb").alias("rb")), crowd, "r")
        quiet = spread_join(ours, theirs, ["key"], "inner", "lid", total, floor)
        pairs = promising(_possible(quiet.where("rid < lid"), threshold), byid, byid, threshold, floor)
        scored = score_pairs(pairs, byid, byid, threshold, floor).select("lid", "rid")
        found = cut(
            crowded_pairs(
                keys.select("lid", "key"),
                keys.select(F.col("lid").alias("rid"), "key"),
                crowd, byid, byid, threshold, block, depth,
            ),
            "crowded",
        )
        edges = cut(scored.unionByName(found.select("lid", "rid")).distinct(), "edges")
        more = found.where("more").select(F.col("lid").alias("seq")).distinct()
        return (
            edges.select(F.col("lid").alias("seq"), F.col("rid").alias("earlier")),
            live.select("seq").join(more, "seq", "left_anti"),
        )

    return find


def crowded_pairs(
    lkeys: DataFrame,
    rkeys: DataFrame,
    crowd: DataFrame,
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    block: int,
    earlier_depth: int | None = None,
) -> DataFrame:
    """``lid, rid, sim, more``: similar pairs that meet in a key of ``crowd``.

    A key's rows are hashed into blocks on both sides and every pair of blocks is
    one group.  Only similar pairs leave a group, never all of its pairs.  With
    ``earlier_depth`` a row returns, per group, that many of its smallest ``rid``
    below its own id, and ``more`` tells that there are others.
    """
    lkind, rkind = _id_types(left, right)

    def sized(keys: DataFrame, name: str) -> DataFrame:
        return (
            keys.join(crowd.select("key"), "key", "left_semi")
            .groupBy("key")
            .agg(F.ceil(F.count("*") / block).cast("long").alias(name))
        )

    sizes = cut(sized(lkeys, "nl").join(sized(rkeys, "nr"), "key"), "crowd-sizes")

    def members(keys: DataFrame, rows: DataFrame, own: str) -> DataFrame:
        vecs = rows.select(F.col("id").alias(own), "vec")
        return keys.join(sizes, "key").join(vecs, own)

    none_l, none_r = (F.lit(None).cast(kind) for kind in (lkind, rkind))
    nl, nr = F.col("nl"), F.col("nr")
    as_left = members(lkeys, left, "lid").select(
        "key", F.pmod(F.xxhash64("lid"), nl).alias("lb"), F.explode(N.numbers(nr)).alias("rb"),
        "lid", none_r.alias("rid"), "vec",
    )
    as_right = members(rkeys, right, "rid").select(
        "key", F.explode(N.numbers(nl)).alias("lb"), F.pmod(F.xxhash64("rid"), nr).alias("rb"),
        none_l.alias("lid"), "rid", "vec",
    )

    def compare(table: pa.Table) -> pa.Table:
        is_left = pc.is_valid(table.column("lid"))
        lefts = table.filter(is_left)
        rights = table.filter(pc.invert(is_left)).sort_by("rid")
        lid, rid = lefts.column("lid").combine_chunks(), rights.column("rid").combine_chunks()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        before = None
        if earlier_depth is not None:
            before = rid.to_numpy()[None, :] < lid.to_numpy()[:, None]
        for at, sims in _products(_flat(lefts), _flat(rights)):
            hit = sims >= threshold
            more = np.zeros(len(sims), bool)
            if before is not None:
                hit &= before[at : at + len(sims)]
                more = hit.sum(axis=1) > earlier_depth
                hit &= np.cumsum(hit, axis=1) <= earlier_depth
            i, j = np.nonzero(hit)
            found.append((i + at, j, sims[i, j], more[i]))
        i, j, sim, more = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"lid": lid.take(pa.array(i)), "rid": rid.take(pa.array(j)), "sim": sim, "more": more})

    return (
        as_left.unionByName(as_right)
        .groupBy("key", "lb", "rb")
        .applyInArrow(compare, f"lid {lkind}, rid {rkind}, sim double, more boolean")
    )


def _products(left: tuple, right: tuple):
    """Rows of the matrix of dot products of two blocks of term vectors, some left rows at a time.

    The right block is turned into lists by term; every left entry meets the list of its term, and
    the products are summed up by pair.
    """
    (lf, lw, lend), (rf, rw, rend) = left, right
    width = len(rend) - 1
    owner = np.repeat(np.arange(width), np.diff(rend))
    by_term = np.argsort(rf, kind="stable")
    rf, rw, owner = rf[by_term], rw[by_term], owner[by_term]
    low = np.searchsorted(rf, lf)
    met = np.searchsorted(rf, lf, side="right") - low
    upto = np.concatenate([[0], np.cumsum(met)])[lend]
    at = 0
    while at < len(lend) - 1:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PRODUCTS, side="right")) - 1)
        own = slice(lend[at], lend[to])
        sizes = met[own]
        place = np.repeat(low[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        row = np.repeat(np.repeat(np.arange(to - at), np.diff(lend[at : to + 1])), sizes)
        sums = np.bincount(row * width + owner[place], rw[place] * np.repeat(lw[own], sizes), (to - at) * width)
        yield at, sums.reshape(to - at, width)
        at = to


def _flat(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, weights and row ends of a table's vectors."""
    vec = side.column("vec").combine_chunks()
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.chunk(0)
    f, w = vec.field("f"), vec.field("w")
    ends = f.offsets.to_numpy().astype(np.int64)
    return (
        f.flatten().to_numpy(zero_copy_only=False),
        w.flatten().to_numpy(zero_copy_only=False),
        ends - ends[0],
    )


# -- dense vectors ----------------------------------------------------------


def dense_finder(
    rows: DataFrame, threshold: float, block: int = N.VISITORS, cell_rows: int = N.CELL_ROWS
):
    """Conflict finder over dense unit vectors for ``keep_first``.  ``rows``: ``seq, vec``.

    All rows are placed in cells once, and with them the cells they have to visit.  Until the last
    depth a row only meets the first rows at home there, as many as a task holds or ``depth`` if that
    is more; only a cell of copies, which can't be cut, has more.  So it falls in one round at
    linear cost.
    """
    placed: dict[str, DataFrame] = {}
    all_rows = rows.select(F.col("seq").alias("id"), "vec")

    def place(n: int) -> N.Cells:
        if not placed:
            cells = placed["cells"] = N.Cells(all_rows, n, cell_rows)
            placed["visits"] = cells.visits(all_rows.withColumn("least", F.lit(float(threshold))))
        return placed["cells"]

    def find(live: DataFrame, depth: int, n: int) -> tuple[DataFrame, DataFrame]:
        cells = place(n)
        living = live.select(F.col("seq").alias("id"))
        visitors = placed["visits"].join(living, "id", "left_semi")
        homes = cells.placed.join(living, "id", "left_semi")
        incomplete = None
        first = max(depth, cell_rows)
        if depth < MAX_DEPTH and n > first:
            order = Window.partitionBy("cell").orderBy("id")
            homes = homes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).drop("_n")
            full = homes.groupBy("cell").agg(F.max("id").alias("last"), F.count("*").alias("n"))
            incomplete = (
                visitors.select("id", "cell")
                .join(full.where(F.col("n") >= first).select("cell", "last"), "cell")
                .where(F.col("id") > F.col("last"))
                .select(F.col("id").alias("seq"))
                .distinct()
            )
        grid = N.grid(cells, visitors, homes, n, n, block)
        found = cut(N.pairs_in(grid, threshold, _id_types(living, living), True, depth), "block")
        edges = found.select(F.col("lid").alias("seq"), F.col("rid").alias("earlier"))
        cut_short = found.where("more").select(F.col("lid").alias("seq")).distinct()
        settled = live.select("seq").join(cut_short, "seq", "left_anti")
        if incomplete is not None:
            settled = settled.join(incomplete, "seq", "left_anti")
        return edges, settled

    return find


def _id_types(left: DataFrame, right: DataFrame) -> tuple[str, str]:
    return (
        left.schema["id"].dataType.simpleString(),
        right.schema["id"].dataType.simpleString(),
    )


def knn(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    n_queries: int,
    n_store: int,
    threshold: float | None = None,
    skip_self: bool = False,
    block: int = N.VISITORS,
    cell_rows: int = N.CELL_ROWS,
) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest stored vectors of every query.

    Cells and tasks return their own k best, so few rows per query reach the final ranking.  A
    threshold may go before the top k: whatever ranks above a row that passes, passes too, and
    it bounds the search from the start.  Equal scores rank by id.
    """
    hits = N.nearest_join(queries, store, k, n_queries, n_store, threshold, skip_self, block, cell_rows)
    return top_k(hits, k)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """Rank hits ``query_id, id, sim`` and keep the first k per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("id"))
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", (1.0 - F.col("sim")).alias("distance"), "sim")
    )


def best_match(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Arg-max of positive similarities; equal scores go to the smallest id."""
    score = F.round("sim", SCORE_DIGITS)
    return (
        hits.where(F.col("sim") > 0)
        .groupBy(by)
        .agg(F.min(F.struct((-score).alias("neg"), F.col("id"))).alias("b"))
        .select(by, F.col("b.id").alias("matching_id"), (-F.col("b.neg")).alias("similarity_score"))
    )
