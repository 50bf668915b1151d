"""N-gram Jaccard self-join with signature trees.

Documents are sets of distinct word shingles; equal sets are one set from here on. Two
sets of a similarity of at least ``percent`` share a shingle among the rarest of each, as
many as could be missing in a partner and one more. So only the rarest shingles route sets
to groups, and shingles that no other set has cost nothing. Routing loses no pair.

Within a group a signature tree holds the sets: leaves are runs of similar size, and each
node has the OR of its members' token bitmaps and their size range. Two trees are walked
together, and a pair of nodes is left when the greatest overlap that the bitmaps and sizes
allow is too small, or when all members are in one component already. What reaches the
leaves is compared by all its shingles.

A link found joins two components at once, so that a large group of near copies becomes one
component after about as many comparisons as members. No pair is skipped for any other
reason, so the components are those of all links. On request, rounds before the trees compare
every member of a group with one member only, the centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm import scan
from fleetgauge.llm.components import components
from fleetgauge.llm.tables import BROADCAST_ROWS, partitions, written

SHINGLE = 5
PERCENT = 80
#: Rounds of comparing with centres before the trees; they change no result. Without any, every
#: link comes from the trees.
CENTRE_ROUNDS = 0
#: Groups of more sets or shingles are met block by block, each pair of blocks on its own.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Children of a node of the tree.
FAN = 8

_TOKEN_BITS = np.uint64(40)


def _set_ids(text: np.ndarray, grams: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each row's shingle set, and its size."""
    sizes = np.bincount(text, minlength=rows)
    ends = np.cumsum(sizes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(scan.mix(grams + np.uint64(0x5851F42D4C957F2D)))])
    return scan.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)), sizes


def _sets(column, size: int):
    """Runs of a text column: (first row, behind the last, texts' rows, shingle hashes)."""
    low, table = scan.lowered(), scan.plain_words()
    raw, offsets = scan.texts(column)
    for a, b in scan.runs(offsets):
        own = offsets[a:b + 1] - offsets[a]
        folded = low[raw[offsets[a]:offsets[b]]]
        starts, ends, heads = scan.words(folded, own, table)
        hashes = scan.span_hashes(scan.prefix_sums(folded), starts, ends)
        yield a, b, *scan.shingle_sets(hashes, heads, size)


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _dealt(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Packed shingles by part of the hash range: for each run of texts and part, the set
    ids, how many shingles each has in the part, and 40 bits of each shingle. The
    documents themselves ride along, once per run."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("sets", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("low", T.BinaryType()),
        T.StructField("high", T.BinaryType()),
        T.StructField("docs", T.ArrayType(T.StructType([
            T.StructField("id", kind), T.StructField("mark", T.LongType()),
            T.StructField("n", T.LongType()), T.StructField("set", T.LongType())])))])

    def deal(batches):
        for batch in batches:
            for a, b, text, grams in _sets(batch.column(2), size):
                ids, sizes = _set_ids(text, grams, b - a)
                part = (grams % np.uint64(parts)).astype(np.int32)
                token = (grams // np.uint64(parts)) & np.uint64((1 << 40) - 1)
                order = np.argsort(part, kind="stable")
                part, token, text = part[order], token[order], text[order]
                edges = np.searchsorted(part, np.arange(parts + 1))
                rows = pa.StructArray.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(sizes.astype(np.int64)), pa.array(ids.view(np.int64))],
                    names=["id", "mark", "n", "set"])
                home = int(ids[0] % np.uint64(parts)) if b > a else 0
                found = {k: [] for k in ("part", "sets", "counts", "low", "high", "docs")}
                for p in range(parts):
                    first, last = edges[p], edges[p + 1]
                    if first == last and p != home:
                        continue
                    own = text[first:last]
                    head = np.flatnonzero(np.diff(own, prepend=-1))
                    found["part"].append(p)
                    found["sets"].append(_blob(ids[own[head]]))
                    found["counts"].append(_blob(np.diff(np.append(head, len(own))).astype(np.uint32)))
                    found["low"].append(_blob(token[first:last].astype(np.uint32)))
                    found["high"].append(_blob((token[first:last] >> np.uint64(32)).astype(np.uint8)))
                    found["docs"].append(p == home)
                mine = np.array(found["docs"])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(mine * (b - a))]).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["part"], pa.int32()),
                     *(pa.array(found[k], pa.binary()) for k in ("sets", "counts", "low", "high")),
                     lists], names=schema.names)

    return docs.select("id", "mark", "text").mapInArrow(deal, schema)


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _repeated(dealt: DataFrame, parts: int) -> DataFrame:
    """For each part: the shingles that more than one set has, sent on by set, with the
    number of sets that have them; and the documents."""
    docs_type = dealt.schema["docs"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("sets", T.BinaryType()),
        T.StructField("tokens", T.BinaryType()), T.StructField("spread", T.BinaryType()),
        T.StructField("docs", docs_type)])

    def count(table):
        part = table.column("part")[0].as_py()
        sets, counts = _joined(table.column("sets"), np.uint64), _joined(table.column("counts"), np.uint32)
        token = _joined(table.column("low"), np.uint32).astype(np.uint64)
        token |= _joined(table.column("high"), np.uint8).astype(np.uint64) << np.uint64(32)
        # A set that came before has the same shingles here: copies leave at this point.
        _, first = np.unique(sets, return_index=True)
        fresh = np.zeros(len(sets), bool)
        fresh[first] = True
        keep = np.repeat(fresh, counts)
        token, owner = token[keep], np.repeat(sets[fresh], counts[fresh])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
        spread = np.diff(np.append(head, len(token)))
        spread = np.repeat(spread, spread)
        many = spread > 1
        token, owner = token[many] | (np.uint64(part) << _TOKEN_BITS), owner[many]
        spread = np.minimum(spread[many], 65535).astype(np.uint16)
        to = (owner % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        token, owner, spread = token[order], owner[order], spread[order]
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(edges))
        spans = [(edges[p], edges[p + 1]) for p in used]
        lists = table.column("docs").combine_chunks()
        rows = len(used)
        out = [pa.array(np.append(used, part).astype(np.int32)),
               *(pa.array([*(_blob(v[a:b]) for a, b in spans), b""], pa.binary())
                 for v in (owner, token, spread))]
        flat = lists.flatten()
        nested = pa.ListArray.from_arrays(
            pa.array(np.append(np.zeros(rows + 1), len(flat)).astype(np.int32)), flat)
        return pa.Table.from_arrays([*out, nested], names=schema.names)

    return dealt.groupBy("part").applyInArrow(count, schema)


def _postings(repeated: DataFrame, sizes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(token, set, n): for each set, the repeated ones among its rarest shingles."""
    blobs = repeated.filter(F.length("sets") > 0).select(
        "part", "sets", "tokens", "spread", F.lit(None).cast("binary").alias("ns"))
    # Set sizes come as small blobs of their own, one for each part and input partition.
    packed = _packed(sizes, parts)

    def cut(table):
        ns = table.column("ns").to_pylist()
        owner, token, spread, known, n = [], [], [], [], []
        for i, sets in enumerate(table.column("sets").to_pylist()):
            if ns[i] is None:
                owner.append(np.frombuffer(sets, np.uint64))
                token.append(np.frombuffer(table.column("tokens")[i].as_py(), np.uint64))
                spread.append(np.frombuffer(table.column("spread")[i].as_py(), np.uint16))
            else:
                known.append(np.frombuffer(sets, np.uint64))
                n.append(np.frombuffer(ns[i], np.int64))
        if not owner:
            return pa.table({"token": pa.array([], pa.int64()), "set": pa.array([], pa.int64()),
                             "n": pa.array([], pa.int64())})
        owner, token, spread = map(np.concatenate, (owner, token, spread))
        known, first = np.unique(np.concatenate(known), return_index=True)
        n = np.concatenate(n)[first]
        order = np.lexsort((token, spread, owner))
        owner, token = owner[order], token[order]
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        have = np.diff(np.append(head, len(owner)))
        size = n[np.searchsorted(known, owner[head])]
        # The rarest: those that a partner may lack, and one more; shingles of one set come first.
        rarest = size - (percent * size + 99) // 100 + 1
        need = np.repeat(rarest - (size - have), have)
        keep = np.arange(len(owner)) - np.repeat(head, have) < need
        return pa.table({"token": pa.array(token[keep].view(np.int64)),
                         "set": pa.array(owner[keep].view(np.int64)),
                         "n": pa.array(np.repeat(size, have)[keep])})

    return blobs.unionByName(packed).groupBy("part").applyInArrow(
        cut, "token long, set long, n long")


def _packed(sizes: DataFrame, parts: int) -> DataFrame:
    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            n = batch.column(1).to_numpy()
            to = (ids % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            ids, n = ids[order], n[order]
            edges = np.searchsorted(to[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)),
                 pa.array([_blob(ids[edges[p]:edges[p + 1]]) for p in used], pa.binary()),
                 pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary()),
                 pa.array([_blob(n[edges[p]:edges[p + 1]]) for p in used], pa.binary())],
                names=["part", "sets", "tokens", "spread", "ns"])

    return sizes.select("set", "n").mapInArrow(
        pack, "part int, sets binary, tokens binary, spread binary, ns binary")


def _fetched(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set, n, grams): the whole shingle sets of the wanted ones, from one document each."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(side.select(F.col("id").alias("id2"), F.col("mark").alias("mark2")),
                      (F.col("mark") == F.col("mark2")) & F.col("id").eqNullSafe(F.col("id2")),
                      "left_semi").select("text")

    def hashed(batches):
        for batch in batches:
            for a, b, text, grams in _sets(batch.column(0), size):
                ids, sizes = _set_ids(text, grams, b - a)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), pa.array(sizes.astype(np.int64)),
                     pa.array([_blob(grams[e - s:e]) for s, e in zip(sizes, ends)], pa.binary())],
                    names=["set", "n", "grams"])

    return texts.mapInArrow(hashed, "set long, n long, grams binary").dropDuplicates(["set"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the size of their overlap and whether they are links."""
    left = sets.select(F.col("set").alias("a"), F.col("grams").alias("mine"))
    right = sets.select(F.col("set").alias("b"), F.col("grams").alias("theirs"))

    def compare(batches):
        for batch in batches:
            a, b, linked = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "mine", "theirs")
    return met.mapInArrow(compare, "a long, b long, linked boolean")


def _sized(percent: int):
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _local_bitmaps(grams: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, one bit for each shingle that two sets of the group share, so
    that common bits count common shingles exactly."""
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, token, held = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    shared = held[token] > 1
    owner, bit = owner[shared], number[token[shared]]
    width = max(1, -(-int((held > 1).sum()) // 64))
    out = np.zeros((len(grams), width), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _tree(bits: np.ndarray, n: np.ndarray, first: int, last: int) -> dict:
    """The root of a tree over members first up to last, which are ordered by size. A node
    has the OR of its members' bitmaps, the range of their sizes and its children."""
    level = [{"first": i, "last": i + 1, "bits": bits[i], "least": int(n[i]), "most": int(n[i]),
              "children": ()} for i in range(first, last)]
    while len(level) > 1:
        level = [{"first": c[0]["first"], "last": c[-1]["last"],
                  "bits": np.bitwise_or.reduce([x["bits"] for x in c]),
                  "least": c[0]["least"], "most": c[-1]["most"], "children": c}
                 for c in (level[i:i + FAN] for i in range(0, len(level), FAN))]
    return level[0]


def _possible(x: dict, y: dict, percent: int) -> bool:
    """Whether some member of x and some of y may be linked: shared shingles lie on shared
    bits, and sizes bound the overlap too. For two leaves the answer is exact."""
    if 100 * x["most"] < percent * y["least"] or 100 * y["most"] < percent * x["least"]:
        return False
    overlap = min(int(np.bitwise_count(x["bits"] & y["bits"]).sum()), x["most"], y["most"])
    return (100 + percent) * overlap >= percent * (x["least"] + y["least"])


def _walk(x: dict, y: dict, label: np.ndarray, percent: int) -> list:
    """Dual traversal: links (places of two members) that join components. ``label`` is
    changed as they do; node pairs within one component are left."""
    found, stack = [], [(x, y)]
    while stack:
        x, y = stack.pop()
        mine, theirs = label[x["first"]:x["last"]], label[y["first"]:y["last"]]
        if mine[0] == theirs[0] and (mine == mine[0]).all() and (theirs == mine[0]).all():
            continue
        if x is not y and not _possible(x, y, percent):
            continue
        if not x["children"] and not y["children"]:
            found.append((x["first"], y["first"]))
            label[label == max(mine[0], theirs[0])] = min(mine[0], theirs[0])
        elif x is y:
            kids = x["children"]
            stack += [(a, b) for i, a in enumerate(kids) for b in kids[i:]]
        elif x["children"] and (not y["children"] or x["last"] - x["first"] >= y["last"] - y["first"]):
            stack += [(c, y) for c in x["children"]]
        else:
            stack += [(x, c) for c in y["children"]]
    return found


def tree_links(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join the components of each group (kind, key, lo, hi) of (set, n,
    label, block, grams): block lo against block hi, or lo within itself. No more links than
    members come out, however many pairs are linked."""
    def traverse(key, table):
        lo, hi = key[2].as_py(), key[3].as_py()
        columns = {c: table.column(c).to_numpy() for c in ("set", "n", "label", "block")}
        order = np.lexsort((columns["set"], columns["label"], columns["n"], columns["block"] != lo))
        ids, n, label, block = (columns[c][order] for c in ("set", "n", "label", "block"))
        stored = table.column("grams").to_pylist()
        bits = _local_bitmaps([np.frombuffer(stored[i], np.uint64) for i in order])
        cut = int((block == lo).sum())
        found: list = []
        label = label.copy()
        if lo == hi:
            root = _tree(bits, n, 0, len(ids))
            found = _walk(root, root, label, percent)
        elif 0 < cut < len(ids):
            found = _walk(_tree(bits, n, 0, cut), _tree(bits, n, cut, len(ids)), label, percent)
        return pa.table({"a": pa.array([min(ids[i], ids[j]) for i, j in found], pa.int64()),
                         "b": pa.array([max(ids[i], ids[j]) for i, j in found], pa.int64())})

    return groups.groupBy("kind", "key", "lo", "hi").applyInArrow(traverse, "a long, b long")


def _grouped(current: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups for the trees: whole clusters of groups that share components, where that sends
    each set less often than the groups one by one; large ones cut into blocks."""
    least = current.groupBy("token").agg(F.min("label").alias("b"))
    clusters = components(current.join(least, "token").select(F.col("label").alias("a"), "b")
                          .filter("a <> b").distinct())
    placed = written(current.join(clusters.select(F.col("node").alias("label"),
                                                  F.col("label").alias("cluster")), "label"), "placed")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    once = placed.select("cluster", "set", "n", "label").distinct()
    whole = once.groupBy("cluster").agg(blocks.alias("blocks"), F.count("*").alias("rows"))
    single = placed.groupBy("cluster", "token").agg(blocks.alias("blocks"), F.count("*").alias("rows"))
    cost = single.groupBy("cluster").agg(F.sum(F.col("rows") * F.col("blocks")).alias("cost"))
    chosen = whole.join(cost, "cluster").select(
        "cluster", "blocks", (F.col("rows") * F.col("blocks") <= F.col("cost")).alias("together"))
    chosen = written(chosen, "clusters")
    shape = ["kind", "key", "set", "n", "label", "blocks"]
    groups = (once.join(chosen.filter("together"), "cluster")
              .withColumns({"kind": F.lit(0), "key": F.col("cluster")}).select(*shape)
              .union(placed.join(chosen.filter("not together").select("cluster"), "cluster", "left_semi")
                     .join(single.drop("cluster", "rows"), "token")
                     .withColumns({"kind": F.lit(1), "key": F.col("token")}).select(*shape)))
    return (groups.withColumn("block", F.expr("cast(pmod(xxhash64(set, 'block'), blocks) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
            .join(sets.select("set", "grams"), "set"))


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups with members of more than one component, with the labels."""
    named = lists.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").select(
        "token", "set", "n", F.coalesce("label", "set").alias("label"))
    several = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(
        "lo <> hi").select("token")
    return named.join(several, "token", "left_semi")


def links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT):
    """(documents, labels) of rows (id, mark, text): each document with its set and the
    set's size, and each linked set with its component's least set."""
    spark = docs.sparkSession
    parts = partitions(spark)
    repeated = written(_repeated(_dealt(docs, size, parts), parts), "repeated-shingles")
    members = repeated.select(F.explode("docs").alias("d")).select("d.*")
    postings = written(_postings(repeated, members.filter("n > 0"), parts, percent), "postings")

    # Groups with the same members stand for one; a fingerprint of members shows them.
    seen = F.xxhash64("set")
    groups = postings.groupBy("token").agg(
        F.count("*").alias("rows"), F.sum(F.pmod(seen, F.lit(1 << 31))).alias("sum"),
        F.bit_xor(seen).alias("mix")).filter("rows > 1")
    chosen = groups.groupBy("rows", "sum", "mix").agg(F.min("token").alias("token")).select("token")
    lists = written(postings.join(chosen, "token", "left_semi").distinct(), "groups")

    involved = lists.select("set").distinct()
    one = members.join(involved, "set", "left_semi").groupBy("set").agg(
        F.min(F.struct("id", "mark")).alias("d")).select("set", "d.id", "d.mark")
    sets = written(_fetched(docs, written(one, "wanted"), size), "sets")

    labels = spark.createDataFrame([], "node long, label long")
    tested = spark.createDataFrame([], "a long, b long")
    current = lists.withColumn("label", F.col("set"))
    for turn in range(CENTRE_ROUNDS):
        shape = current.groupBy("token").agg(F.count("*").alias("c")).agg(
            F.sum("c").alias("rows"), F.sum(F.expr("c * (c - 1) div 2")).alias("pairs")).first()
        if not shape.rows or (turn and shape.pairs <= 4 * shape.rows):
            break
        order = F.xxhash64("set", F.lit(turn))
        centres = current.groupBy("token").agg(
            F.min(F.struct(order.alias("o"), "set", "n", "label")).alias("c")).select(
            "token", F.col("c.set").alias("set2"), F.col("c.n").alias("n2"),
            F.col("c.label").alias("label2"))
        pairs = (current.join(centres, "token").filter(F.col("label") != F.col("label2"))
                 .filter(_sized(percent)).select(*_pair("set", "set2")).distinct()
                 .join(tested, ["a", "b"], "left_anti"))
        checked = written(_verified(pairs, sets, percent), "checked")
        tested = tested.union(checked.select("a", "b"))
        labels = components(checked.filter("linked").select("a", "b").union(
            labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        current = written(_mixed(lists, labels), "groups")

    if not current.isEmpty():
        joined = written(tree_links(_grouped(current, sets), percent).distinct(), "tree-links")
        labels = components(joined.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    return members, labels


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
         percent: int = PERCENT) -> DataFrame:
    """One row per document: id, mark (a hash of the text), n_shingles, component_id, group.

    The component id is the least id among all documents that links lead to, the document
    itself included; the group is the component's number, null for a document without
    shingles. A text of fewer words than ``size`` has its whole sequence as its one
    shingle. Null texts and texts without words have none, and are linked with nothing.
    Rows with the same id are documents of their own; a null id is never the least unless
    all of a component are null. No rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    members, labels = links(rows, size, percent)
    full = (members.filter("n > 0").join(labels.select(F.col("node").alias("set"), "label"), "set", "left")
            .withColumn("group", F.coalesce("label", "set")))
    full = written(full, "labelled")
    least = full.groupBy("group").agg(F.min("id").alias("component_id"))
    shape = ["id", "mark", F.col("n").alias("n_shingles"), "component_id", "group"]
    return full.join(least, "group").select(*shape).union(
        members.filter("n = 0").withColumn("component_id", F.col("id"))
        .withColumn("group", F.lit(None).cast("long")).select(*shape))


def copies(found: DataFrame) -> DataFrame:
    """(id, mark) of the documents that go when the first of each group stays.

    The first is the one with the least id, nulls last, then the least mark. ``found`` is a
    written result of join(). Rows that share both values with the first are not listed.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("f")
    stay = found.filter("group is not null").groupBy("group").agg(first).select(
        F.col("f.id").alias("id2"), F.col("f.mark").alias("mark2"))
    same = (F.col("mark") == F.col("mark2")) & F.col("id").eqNullSafe(F.col("id2"))
    return found.filter("group is not null").join(stay, same, "left_anti").select("id", "mark").distinct()
