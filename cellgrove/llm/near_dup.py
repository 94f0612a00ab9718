"""Near-duplicate documents by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.arrow import by_slices, lists
from cellgrove.llm.components import merged
from cellgrove.llm.shared import Store, text_key
from cellgrove.llm.words import U64, gram_hashes, mix, span_hashes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rounds in which every posting list compares its members with one of them.
STAR_ROUNDS = 2


def _multipliers(k: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, k, dtype=U64) * U64(2) + U64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int):
    """The distinct shingle hashes of every row, sorted; a row of fewer words than `size` has its whole sequence as one."""
    buf = _LOWER[buf]
    starts, ends, first = word_spans(buf, offsets)
    words = span_hashes(buf, starts, ends)
    grams = gram_hashes(words, size)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield gram_hashes(words[a:b], int(b - a)) + U64(b - a)
        else:
            yield np.zeros(0, dtype=U64)


def signature(values: np.ndarray, by: np.ndarray, rows: int) -> np.ndarray:
    """MinHash under every multiplier, `rows` of them in each coordinate; its number is mixed in, so a value stands for itself."""
    low = np.full(len(by), np.iinfo(np.uint64).max, dtype=U64)
    for a in range(0, len(values), 4096):
        part = values[a : a + 4096] * by[:, None]
        part ^= part >> U64(29)
        np.minimum(low, part.min(axis=1), out=low)
    out = np.arange(len(by) // rows, dtype=U64)
    for part in low.reshape(-1, rows).T:
        out = mix(out * U64(0x9E3779B97F4A7C15) + part)
    return out


def _set_hash(values: np.ndarray) -> int:
    return int(np.add.reduce(mix(values ^ U64(0x5851F42D4C957F2D))) + U64(len(values)))


def _sketch(size: int, k: int, per: int):
    by = _multipliers(k * per)

    def f(rows, buf, offsets):
        n, keys, sigs = [], [], np.zeros((rows.num_rows, k), dtype=U64)
        for i, s in enumerate(shingle_sets(buf, offsets, size)):
            n.append(len(s))
            keys.append(_set_hash(s))
            if len(s):
                sigs[i] = signature(s, by, per)
        out = [rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(np.array(keys, dtype=U64).view(np.int64))]
        out.append(lists(sigs.view(np.int64).ravel(), np.arange(rows.num_rows + 1) * k, pa.int64()))
        return pa.RecordBatch.from_arrays(out, ["doc_id", "rid", "n_shingles", "v", "sig"])

    return by_slices(f)


def _sets(size: int):
    def f(rows, buf, offsets):
        sets = list(shingle_sets(buf, offsets, size))
        keys = np.array([_set_hash(s) for s in sets], dtype=U64).view(np.int64)
        at = np.r_[0, np.cumsum([len(s) for s in sets])]
        return pa.RecordBatch.from_arrays([pa.array(keys), lists(np.concatenate(sets).view(np.int64), at, pa.int64())], ["v", "shingles"])

    return by_slices(f)


def _mixed(posted: DataFrame, labels: DataFrame | None, store: Store) -> DataFrame:
    """Postings (token, v, centrality, label) of the lists that hold more than one component."""
    label = F.col("v") if labels is None else F.coalesce("label", "v")
    at = (posted if labels is None else posted.join(labels, "v", "left")).select("token", "v", "centrality", label.alias("label"))
    at = store.put(at)
    mixed = store.put(at.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"))
    return store.put(at.join(mixed, "token", "left_semi"))


def _rest(inside: DataFrame, percent: int, store: Store) -> DataFrame:
    """Pairs (a, b) of different components among vertices (v, label, shingles) that may still be alike.

    A pair of sets of n and m shingles is alike only if it shares at least
    need = percent * (n + m) / (100 + percent) of them, so one of the rarest
    (those each holds alone included) n - need + 1 of either. Sizes are dealt
    into steps of 8 %, which makes `need` sharp: the members of a large group
    that are too far from all others have nothing left to be posted under.
    """
    each = inside.select("v", F.explode("shingles").alias("token"))
    df = store.put(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    held = each.join(df, "token").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    step = 1.08
    sized = inside.select("v", "label", F.size("shingles").alias("n")).withColumn("b", F.floor(F.log(F.col("n")) / F.log(F.lit(step)) + 1e-9).cast("int"))
    reach = int(np.ceil(np.log(100 / percent) / np.log(step))) + 1
    with_partner = sized.join(held, "v").select("v", "label", "n", "b", "t", F.explode(F.sequence(F.col("b") - reach, F.col("b") + reach)).alias("p"))
    least = F.greatest(F.floor(F.pow(F.lit(step), F.col("p")) - 1e-6), F.ceil(F.col("n") * percent / 100))
    need = F.ceil((F.col("n") + least) * percent / (100 + percent) - 1e-9).cast("int")
    count = F.size("t") - need + 1
    tokens = F.transform(F.slice("t", 1, F.greatest(count, F.lit(0))), lambda x: x["token"])
    key = [F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"), (F.col("b") <= F.col("p")).alias("small"), (F.col("b") >= F.col("p")).alias("large")]
    posts = store.put(with_partner.where(count > 0).select("v", "label", "n", F.size("t").alias("s"), *key, F.posexplode(tokens).alias("at", "token")))
    lists = posts.groupBy("token", "lo", "hi").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("small").alias("s"), F.max("large").alias("l"))
    lists = store.put(lists.where("a <> b AND s AND l").select("token", "lo", "hi"))
    left = store.put(posts.join(lists, ["token", "lo", "hi"], "left_semi"))
    right = left.where("large").select("token", "lo", "hi", F.col("v").alias("w"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("s").alias("ws"), F.col("at").alias("wat"))
    # the first shingle that both are posted under has at least `need` shared ones from it on, in either order
    able = f"label <> other AND 100 * least(n, m) >= {percent} * greatest(n, m) AND {100 + percent} * least(s - at, ws - wat) >= {percent} * (n + m)"
    pairs = left.where("small").join(right, ["token", "lo", "hi"]).where(able)
    return store.put(pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80, k: int = 64, rows_each: int = 2, matches: int = 22, name: str = "near") -> DataFrame:
    """Group documents whose shingle sets have 100 * intersection >= percent * union.

    Returns one row per input row: doc_id, rid (64-bit key of id and text),
    n_shingles, component_id (the least doc_id that links reach), kept (doc_id
    is component_id) and elected (the one of its group to keep: the least id,
    null ids last, then the least rid; only repeated rows share it).

    Words are runs of bytes but white space, A-Z lowered; a shingle is `size`
    words. Rows with equal sets are one vertex. A vertex's signature has k
    coordinates of `rows_each` MinHash values; pairs that agree in `matches` of
    them are compared on the whole sets (for 0.8, 64, 2 and 22 a true pair is
    missed with probability 4e-7). Two signatures that agree in that many places share one of any
    k - matches + 1 coordinates, so each vertex is posted only under its rarest
    ones (prefix); a vertex with fewer than `matches` values that any other
    vertex has is not posted at all (skip). Every posting list first compares
    its members with one member, the most central and then another, which joins
    large groups in time linear in their size; vertices that still share a list
    but no component are compared by whole sets (_rest), so no link is lost.

    Null or empty text: n_shingles 0, a component of its own. Null ids: the row
    takes part, its id can't become a component's. Repeated rows and ties are
    in one component and carry one verdict. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, name, direct=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    base = store.put(rows, mapped=(_sketch(size, k, rows_each), "doc_id long, rid long, n_shingles long, v long, sig array<long>"))

    least = lambda *c: F.min(F.struct(F.col(c[0]).isNull().alias("no_id"), *[F.col(x).alias(y) for x, y in zip(c, ("id", "rid"))]))
    classes = base.where("n_shingles > 0").groupBy("v").agg(least("doc_id", "rid").alias("one"), F.min("rid").alias("rid"))
    classes = store.put(classes.select("v", "rid", F.col("one.id").alias("first_id"), F.col("one.rid").alias("first_rid")))
    one = store.put(base.where("n_shingles > 0").join(classes.select("v", "rid"), ["v", "rid"]).groupBy("v").agg(*[F.first(c).alias(c) for c in ("n_shingles", "sig", "rid")]))
    tokens = one.select("v", F.explode("sig").alias("token"))
    shared = store.put(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    mine = tokens.join(shared, "token").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"), F.sum("df").alias("centrality")).where(F.size("t") >= matches)
    prefix = F.slice("t", 1, F.size("t") - F.lit(matches - 1))
    posted = store.put(mine.select("v", "centrality", F.explode(F.transform(prefix, lambda x: x["token"])).alias("token")).distinct())
    met = store.put(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"))
    alone, posted = posted, store.put(posted.join(met, "token"))
    store.drop(alone, met, shared)

    some = store.put(posted.select("v").distinct().join(one, "v").select("v", "n_shingles", "sig", "rid"))
    store.drop(one)
    text = rows.join(some.select("rid"), "rid", "left_semi").select("text")
    sets = store.put(text.mapInArrow(_sets(size), "v long, shingles array<long>").join(some.select("v"), "v", "left_semi").dropDuplicates(["v"]))

    def linked(pairs: DataFrame, by_signature: bool) -> DataFrame:
        """Those of the pairs (a, b) that the whole sets confirm."""
        n = lambda e, c: some.select(F.col("v").alias(e), F.col(c).alias(f"{c}_{e}"))
        near = pairs.join(n("a", "n_shingles"), "a").join(n("b", "n_shingles"), "b")
        near = near.where(f"100 * least(n_shingles_a, n_shingles_b) >= {percent} * greatest(n_shingles_a, n_shingles_b)")
        if by_signature:
            near = near.join(n("a", "sig"), "a").join(n("b", "sig"), "b").where(F.size(F.array_intersect("sig_a", "sig_b")) >= matches).drop("sig_a", "sig_b")
        x = lambda e: sets.select(F.col("v").alias(e), F.col("shingles").alias(f"x_{e}"))
        full = near.join(x("a"), "a").join(x("b"), "b").withColumn("both", F.size(F.array_intersect("x_a", "x_b")))
        return full.where(f"100L * both >= {percent}L * (n_shingles_a + n_shingles_b - both)").select("a", "b")

    labels = None
    for r in range(STAR_ROUNDS):
        at = _mixed(posted, labels, store)
        if at.isEmpty():
            break
        pick = F.max(F.struct("centrality", "v", "label")) if r == 0 else F.min(F.struct(F.xxhash64("v", F.lit(r)).alias("turn"), "v", "label"))
        centre = store.put(at.groupBy("token").agg(pick.alias("c")).select("token", F.col("c.v").alias("c"), F.col("c.label").alias("lc")))
        pairs = at.join(centre, "token").where("c <> v AND lc <> label").select(F.least("c", "v").alias("a"), F.greatest("c", "v").alias("b"))
        new = store.put(linked(store.put(pairs.distinct()), True))
        labels = merged(labels, new, store)
    at = _mixed(posted, labels, store)
    if not at.isEmpty():
        inside = at.select("v", "label").distinct().join(sets, "v")
        new = store.put(linked(_rest(store.put(inside), percent, store), False))
        labels = merged(labels, new, store)

    if labels is None:
        links = classes.select("v", F.col("first_id").alias("component_id"), F.col("first_rid").alias("elected"))
    else:
        joined = store.put(classes.drop("rid").join(labels, "v", "left").select("v", "first_id", "first_rid", F.coalesce("label", "v").alias("label")))
        heads = store.put(joined.groupBy("label").agg(least("first_id", "first_rid").alias("one")))
        links = joined.join(heads, "label").select("v", F.col("one.id").alias("component_id"), F.col("one.rid").alias("elected"))
    links = store.put(links)
    out = base.select("doc_id", "rid", "n_shingles", "v").join(links, "v", "left")
    worded = F.col("n_shingles") > 0
    own = F.when(worded, F.col("component_id")).otherwise(F.col("doc_id"))
    elected = F.when(worded, F.col("elected") == F.col("rid")).otherwise(F.lit(True))
    return out.select("doc_id", "rid", "n_shingles", own.alias("component_id"), elected.alias("elected")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
