"""Near-duplicate components by a chosen-path set similarity join.

1. Every text becomes its set of distinct word shingles. Texts with the same
   set form a class, which gets a number and goes on as one member.
2. Each class has a sketch of ``SKETCH`` minwise tokens. In each of ``trees``
   independent trees, a node draws coordinates at random (about 1/threshold of
   them) and branches its members by their token there. Nodes of one member
   end, nodes of at most ``node`` members are compared exhaustively by
   sketch, larger ones branch on, at most ``depth`` times. A large node left
   at that depth is a dense group: it is compared block by block, all pairs of
   blocks being covered, so nothing is capped. One step of twelve trees misses a
   pair at the threshold with probability under 1e-8; nodes that branch to the
   full depth miss it with 0.003, a closer one less.
3. A small node gives out a spanning forest of the pairs whose sketches agree
   in at least ``CUT`` of their places: fewer links than members. Components
   of these links are the candidate groups; they hold every class of a
   similar pair (a true pair falls below the cut with probability under 1e-5).
4. Candidate groups are settled on full sets: exact intersections by inverted
   lists, each member compared with all members not yet connected to it.
   A group whose sets exceed ``budget`` shingles is dealt into blocks: blocks
   are settled first, then pairs of blocks that still hold different components
   are settled again, each with only those members that the other block has
   another component for. So memory stays bounded and no link is lost.

Null texts and texts without words have an empty set and link with nothing.
Texts with fewer words than ``words`` have one shingle, the whole sequence.
Rows with a repeated id are the same document: whatever links with one of
their sets is in one component with all of them, while a row without words
stays its own component. Rows without an id link with nothing, have no
component and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.store import release, remove, saved, small_batches
from kvlake.llm.words import BLOCK_BYTES, Words, blocks, digest, mix, scan, windows

SKETCH = 128
#: Least share of agreeing places for a candidate pair: 4.5 standard deviations below a similarity of 0.75.
CUT = 0.57
#: Places that agree with a node's pivot: 0.85 of them, and 0.25 less with a margin of 3.5 deviations.
TIGHT, NEAR = 109, 58
_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(w: Words, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    hashes = w.hashes()
    runs, out = windows(hashes, words), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                whole = np.array([b - a], np.uint64)
                for h in hashes[a:b]:
                    whole = mix(whole * np.uint64(0xFF51AFD7ED558CCD) + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> list[bytes | None]:
    """The minwise tokens (32 bits) of each set at all places; None for empty sets."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    values = np.concatenate(full)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    out = np.empty((len(full), SKETCH), np.uint64)
    x, high = np.empty_like(values), np.empty_like(values)
    with np.errstate(over="ignore"):
        for i in range(SKETCH):
            np.multiply(values, _SEEDS[i], out=x)
            np.right_shift(x, np.uint64(32), out=high)
            np.bitwise_xor(x, high, out=x)
            out[:, i] = np.minimum.reduceat(x, begins)
    rows = iter((mix(out) >> np.uint64(32)).astype(np.uint32))
    return [next(rows).tobytes() if len(s) else None for s in sets]


def describe(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch, "text"):
                sets = shingle_sets(scan(texts, lower=True), words)
                ids = batch.column(0).slice(at, len(texts))
                marks = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([m[0] for m in marks], pa.int64()),
                        pa.array([m[1] for m in marks], pa.int64()),
                        pa.array(sketches(sets), pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "sketch"],
                )

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary")


# -- trees ----------------------------------------------------------------------------------------------------------------------


def _children(keys: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child key) for every coordinate that a row's node draws. keys: node of each row; tokens: rows x SKETCH."""
    with np.errstate(over="ignore"):
        drawn = mix(keys[:, None] * np.uint64(0x9FB21C651E98DF25) + _SEEDS[None, :])
        limit = np.uint64(int((1 << 64) / (threshold * SKETCH)))
        pick = drawn < limit
        none = ~pick.any(axis=1)  # a node draws one coordinate at least
        pick[np.flatnonzero(none), drawn[none].argmin(axis=1)] = True
        row, place = np.nonzero(pick)
        return row, mix(drawn[row, place] ^ mix(tokens[row, place].astype(np.uint64) + np.uint64(1)))


def _branch(rows: DataFrame, threshold: float, roots: int = 0) -> DataFrame:
    """Children of (doc, node, sketch) rows, as (doc, node). With ``roots``, rows are (doc, sketch) and stand below every root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 2048):
                part = batch.slice(at, 2048)
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
                for root in range(roots) if roots else [None]:
                    keys = mix(np.full(len(tokens), root + 1, np.uint64)) if roots else part.column(2).to_numpy().view(np.uint64)
                    row, child = _children(keys, tokens, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 2048][row]), pa.array(child.view(np.int64))], ["doc_id", "node"])

    cols = ["doc_id", "sketch"] if roots else ["doc_id", "sketch", "node"]
    return rows.select(*cols).mapInArrow(run, "doc_id long, node long")


def forest(tokens: np.ndarray, cut: float = CUT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that agree in ``cut`` of their places."""
    n = len(tokens)
    label, links = np.arange(n), []
    need = int(np.ceil(cut * tokens.shape[1]))
    for i in range(n - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            continue
        hits = others[(tokens[others] == tokens[i]).sum(axis=1) >= need]
        _, first = np.unique(label[hits], return_index=True)
        for j in hits[first].tolist():
            links.append((i, j))
            label[label == label[j]] = label[i]
    return links


def _low(column: pa.Array) -> pa.Array:
    tokens = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in column.to_pylist()]
    return pa.array(tokens, pa.binary())


def _packed_nodes(members: DataFrame, parts: int) -> DataFrame:
    """Links of small nodes; members are dealt by node and sorted, so that a task walks over many nodes without a call for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_node, held_ids, held = None, [], []

        def links() -> pa.RecordBatch | None:
            if len(held_ids) < 2:
                return None
            tokens = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
            found = forest(tokens)
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array([held_ids[i] for i, _ in found], pa.int64()), pa.array([held_ids[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            nodes, ids, low = (batch.column(i).to_pylist() for i in range(3))
            for node, doc, sig in zip(nodes, ids, low, strict=True):
                if node != held_node:
                    if out := links():
                        yield out
                    held_node, held_ids, held = node, [], []
                held_ids.append(doc)
                held.append(sig)
        if out := links():
            yield out

    return members.select("node", "doc_id", "low").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _dense(large: DataFrame, classes: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """(members to compare, rows that branch on) of large nodes (doc_id, node, n).

    Each node has a pivot, a member drawn by hash. Members that agree with it
    in ``TIGHT`` places are linked to it, so pairs of them are joined already. By
    the triangle inequality of the Jaccard distance, only members that agree
    in ``NEAR`` places can be similar to a tight one. Where most members are
    tight and few are near, tight members are dealt into blocks, each with the
    pivot and all near members, and leave the tree; the rest branches on. All
    other nodes branch on whole.
    """
    low = large.join(classes.select("doc_id", "low"), "doc_id")
    pivots = low.groupBy("node").agg(F.min_by(F.struct("doc_id", "low"), F.xxhash64("node", "doc_id")).alias("p"))
    both = low.join(pivots.selectExpr("node", "p.doc_id as pivot", "p.low as pivot_low"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
            agree = pa.array((x == y).sum(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], agree], [*batch.schema.names[:4], "agree"])

    marked = both.select("doc_id", "node", "n", "pivot", "low", "pivot_low").mapInArrow(run, "doc_id long, node long, n long, pivot long, agree int")
    marked, _ = saved(marked)
    is_near = f"agree >= {NEAR} and agree < {TIGHT}"
    stats = marked.groupBy("node").agg(F.count_if(F.expr(f"agree >= {TIGHT}")).alias("tight"), F.count_if(F.expr(is_near)).alias("near"))
    known = marked.join(stats, "node").withColumn("dense", F.expr(f"tight * 2 >= n and near * 4 <= {node}"))
    blocks_of = F.ceil(F.col("tight") * 2 / node).cast("int")
    own = F.array(F.pmod(F.xxhash64("doc_id"), blocks_of).cast("int"))
    inside = known.filter(f"dense and agree >= {NEAR}").withColumn(
        "block", F.explode(F.when((F.col("agree") < TIGHT) | (F.col("doc_id") == F.col("pivot")), F.sequence(F.lit(0), blocks_of - 1)).otherwise(own))
    )
    compare = inside.select("doc_id", F.xxhash64("node", "block").alias("node"))
    return compare, known.filter(f"not dense or agree < {TIGHT}").select("doc_id", "node", "n")


def candidate_links(classes: DataFrame, threshold: float, trees: int, node: int, depth: int, parts: int) -> tuple[DataFrame, list[str]]:
    """Links between classes (doc_id, sketch, low) whose sketches agree; saved tables that it reads."""
    level, paths, out = _branch(classes, threshold, roots=trees), [], []

    def compare(members: DataFrame) -> None:
        links, path = saved(_packed_nodes(members.join(classes.select("doc_id", "low"), "doc_id"), parts))
        paths.append(path)
        out.append(links)

    for at in range(depth + 1):
        level, level_path = saved(level)
        sized, path = saved(level.join(level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node").select("doc_id", "node", "n"))
        remove(classes.sparkSession, level_path)
        paths.append(path)
        compare(sized.filter(F.col("n") <= node))
        large = sized.filter(F.col("n") > node)
        if large.isEmpty():
            break
        inside, rest = _dense(large, classes, node)
        compare(inside)
        if at < depth:
            level = _branch(rest.join(classes.select("doc_id", "sketch"), "doc_id"), threshold)
        else:
            blocks_of = F.ceil(F.col("n") * 2 / node).cast("int")
            dealt = rest.withColumn("mine", F.pmod(F.xxhash64("doc_id"), blocks_of).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
            compare(dealt.select("doc_id", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node")))
        release(classes.sparkSession)
    links = out[0]
    for x in out[1:]:
        links = links.union(x)
    return links, paths


# -- components -----------------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(doc_id, component) of every end of a link; the component is the smallest id that links reach. Saved.

    Alternating star steps: each vertex hands its neighbours the smallest id it knows; the number of rounds grows with the
    logarithm of the longest path, and rows never exceed twice the links.
    """
    spark = links.sparkSession
    edges, path = saved(links.filter("a <> b").selectExpr("greatest(a, b) as v", "least(a, b) as u").distinct())
    seal = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    mark = seal(edges)
    while True:
        both = edges.union(edges.selectExpr("u as v", "v as u"))
        # what a join reads is saved before: its sides are then plain shuffles, and a vertex with very many neighbours can be split over tasks
        least, least_path = saved(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")))
        larger = edges.select(F.col("v").alias("w"), F.col("u").alias("v"))
        large, large_path = saved(larger.join(least.hint("merge"), "v").select(F.col("w").alias("v"), F.col("m").alias("u")))
        low, low_path = saved(large.groupBy("v").agg(F.min("u").alias("m")))
        # small star: smaller neighbours, and the vertex itself, join the smallest
        joined = large.join(low.hint("merge"), "v")
        pairs = F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        small = joined.select(F.explode(pairs).alias("p")).select("p.v", "p.u").filter("v <> u").distinct()
        nxt, nxt_path = saved(small)
        remove(spark, path, least_path, large_path, low_path)
        edges, path, before, mark = nxt, nxt_path, mark, seal(nxt)
        release(spark)
        if mark == before:
            break
    own = edges.select(F.col("v").alias("doc_id"), F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("doc_id"), F.col("u").alias("component")).distinct()
    return own.union(roots), path


# -- settling on full sets ------------------------------------------------------------------------------------------------------


def settle(sets: list[np.ndarray], num: int, den: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the graph that joins sets with den * intersection >= num * union.

    Sets that start with one label count as joined. Each set is compared, by
    inverted lists, with all that are not yet reached; no pair is left out.
    """
    n, links = len(sets), []
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.arange(n) if label is None else label.copy()
    values, ids = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, int))
    ids = ids.astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    by_value = np.argsort(ids, kind="stable")
    lists, starts = owner[by_value], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(values)))])
    left = np.ones(n, bool)
    left_lists, left_starts, built = lists, starts, n

    def rebuild() -> tuple[np.ndarray, np.ndarray]:
        keep = left[lists]
        return lists[keep], np.concatenate([[0], np.cumsum(keep)])[starts]

    for seed in range(n):
        if not left[seed]:
            continue
        queue = np.flatnonzero(left & (label == label[seed])).tolist()
        left[queue] = False
        while queue:
            x = queue.pop()
            if not left.any():
                return links
            if (now := int(left.sum())) * 2 < built or (now < 32 and now != built):
                left_lists, left_starts = rebuild()
                built = now
            mine = ids[begins[x] : begins[x + 1]]
            a, b = left_starts[mine], left_starts[mine + 1]
            count = b - a
            if not count.sum():
                continue
            at = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(left_lists[at], minlength=n)
            hits = np.flatnonzero(left & (den * both >= num * (sizes + sizes[x] - both)) & (both > 0))
            for y in hits.tolist():
                if left[y]:
                    links.append((x, y))
                    more = np.flatnonzero(left & (label == label[y]))
                    left[more] = False
                    queue.extend(more.tolist())
    return links


def joined(ids: list[int], links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(id, smallest id of its component) of all linked members but the smallest."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        if ids[a] > ids[b]:
            a, b = b, a
        parent[b] = a
    return sorted({(ids[i], ids[r]) for i in range(len(ids)) if ids[r := root(i)] != ids[i]})


def _settled(groups: DataFrame, words: int, num: int, den: int, parts: int) -> DataFrame:
    """Links (member, smallest member of its component) of each group of (grp, doc_id, d1, d2, known, text).

    Rows with one value of known are joined already; texts whose set is not that of (d1, d2) are another class's and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, [], [], []]

        def links() -> pa.RecordBatch | None:
            _, ids, known, sets = held
            if len(ids) < 2:
                return None
            _, label = np.unique(np.array(known, np.int64), return_inverse=True)
            star = joined(ids, settle(sets, num, den, label))
            if not star:
                return None
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in star], pa.int64()), pa.array([b for _, b in star], pa.int64())], ["a", "b"])

        for batch in batches:
            keys, ids, known, d1, d2 = (batch.column(i).to_pylist() for i in range(5))
            for at, texts in blocks(batch, "text", BLOCK_BYTES):
                for i, s in enumerate(shingle_sets(scan(texts, lower=True), words), at):
                    if digest(s) != (d1[i], d2[i]):
                        continue
                    if keys[i] != held[0]:
                        if out := links():
                            yield out
                        held[:] = [keys[i], [], [], []]
                    held[1].append(ids[i])
                    held[2].append(known[i])
                    held[3].append(s)
        if out := links():
            yield out

    dealt = groups.select("grp", "doc_id", "known", "d1", "d2", "text").repartition(parts, "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similarity: tuple[int, int] = (75, 100),
    trees: int = 12,
    node: int = 4096,
    depth: int = 4,
    budget: int = 2_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    num, den = similarity
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    rows, _ = saved(describe(docs, words, doc_id, text))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    sketched = F.struct("n_shingles", "sketch")
    by_set = full.groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", sketched.alias("s")), "doc_id").alias("r"))
    numbered = by_set.select("d1", "d2", F.col("r.doc_id").alias("rep"), "r.s.*", F.monotonically_increasing_id().alias("doc_id"))
    classes, classes_path = saved(_with_low(numbered))
    links, paths = candidate_links(classes, num / den, trees, node, depth, parts)
    found, found_path = components(links)
    remove(spark, *paths)

    # ids that stand in several rows: their texts are taken once, and their classes are linked
    repeats, repeats_path = saved(full.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    texts = docs.select(docs[doc_id].cast("long").alias("rep"), docs[text].alias("text"))
    same: DataFrame | None = None
    if not repeats.isEmpty():
        texts = texts.join(repeats.withColumnRenamed("doc_id", "rep"), "rep", "left_anti").union(texts.join(repeats.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").distinct())
        own = full.join(repeats, "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct()
        own = own.join(classes.select(F.col("doc_id").alias("a"), "d1", "d2"), ["d1", "d2"])
        same = own.join(own.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").filter("a <> b").select("a", "b")

    # candidate groups with their texts; groups over the budget are dealt into blocks
    sized = found.join(classes.select("doc_id", "n_shingles", "rep", "d1", "d2"), "doc_id")
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    n_blocks = F.greatest(F.ceil(F.col("total") * 2 / budget), F.lit(1)).cast("int")
    member = (
        sized.join(totals, "component")
        .withColumn("n_blocks", F.when(F.col("total") <= budget, F.lit(1)).otherwise(n_blocks))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), "n_blocks").cast("int"))
        .select("doc_id", "rep", "d1", "d2", "component", "n_blocks", "block")
    )
    member, member_path = saved(member)
    # the members grow with the input: texts are dealt by id at every size, never met by a broadcast
    first = texts.join(member.select("rep", "doc_id", "d1", "d2", F.xxhash64("component", "block").alias("grp"), F.col("doc_id").alias("known")).hint("merge"), "rep")
    exact, exact_path = saved(_settled(first, words, num, den, parts))
    gone = [member_path, found_path, exact_path, repeats_path]
    if not member.filter("n_blocks > 1").isEmpty():
        known, known_path = components(exact)
        labelled = member.filter("n_blocks > 1").join(known.withColumnRenamed("component", "known"), "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))
        labelled, labelled_path = saved(labelled)
        held = labelled.groupBy("component", F.col("block").alias("other")).agg(F.min("known").alias("lo"), F.max("known").alias("hi"))
        # a member goes to the blocks that hold another component than its own
        apart = labelled.join(held, "component").filter("other <> block and (lo <> known or hi <> known)")
        apart = apart.withColumn("grp", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"), F.lit(1)))
        more, more_path = saved(_settled(texts.join(apart.select("rep", "doc_id", "d1", "d2", "grp", "known").hint("merge"), "rep"), words, num, den, parts))
        exact = exact.union(more)
        gone += [known_path, labelled_path, more_path]
    if same is not None:
        exact = exact.union(same)
    if len(gone) > 4 or same is not None:
        final, final_path = components(exact)
    else:  # every group was settled whole
        final, final_path = saved(exact.selectExpr("a as doc_id", "b as component"))
    remove(spark, *gone)

    reach = classes.select("doc_id", "rep", "d1", "d2").join(final, "doc_id", "left").withColumn("root", F.coalesce("component", "doc_id"))
    reach, _ = saved(reach.select("d1", "d2", "rep", "root"))
    remove(spark, classes_path, final_path)
    least = reach.groupBy("root").agg(F.min("rep").alias("component"))
    out = rows.drop("sketch").join(reach.join(least, "root").select("d1", "d2", "component"), ["d1", "d2"], "left")
    component: Column = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", kept)


def _with_low(classes: DataFrame) -> DataFrame:
    """Adds the low byte of every token, by which sketches are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _low(batch.column("sketch"))], [*batch.schema.names, "low"])

    return classes.mapInArrow(run, "d1 long, d2 long, rep long, n_shingles long, sketch binary, doc_id long, low binary")
