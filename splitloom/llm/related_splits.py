"""Splits that keep related records together (hash-to-min components, weighted rendezvous hashing)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitloom.functions.ids import spelled_number, spelled_numbers
from splitloom.workspace import Workspace, join_per_key, size_measures

#: Bits that hold a number; the kind of vertex stands above them. Speakers come first, so a component's
#: smallest vertex is its smallest speaker, if it has one.
_SHIFT = 1 << 60
SPEAKER, AUTHOR, CHAPTER = 0, 1, 2


def hash_to_min(edges: DataFrame, ws: Workspace | None = None, max_rounds: int = 64) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(src, dst)``; the component is its smallest vertex.

    Every vertex holds a cluster, kept as one row per member. In a round it sends the whole cluster to the
    cluster's minimum and that minimum to every member, until nothing changes: the minimum then holds the
    component and every other vertex holds the minimum alone. A hub's cluster is never gathered; only its
    minimum is aggregated (map side first), and hubs meet it by a broadcast of bounded size. Loops, repeated
    and reversed edges are allowed. Edges with a null end are dropped. An empty table gives an empty result.
    """
    ws = ws or Workspace(edges.sparkSession, "hashtomin")
    edges = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    # both directions of an edge and both of its ends, from one pass over the edges
    ends = [F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v in ("src", "dst") for u in ("src", "dst")]
    cur = ws.write(edges.select(F.explode(F.array(*ends)).alias("p")).select("p.v", "p.u").distinct())
    for _ in range(max_rounds):
        # nothing changes any more when every cluster is a single vertex or that of its own minimum
        open_ = F.count_if((F.col("v") != F.col("m")) & (F.col("n") > 1))
        low, measured = ws.write_with(cur.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), **size_measures(), open=open_)
        if not measured["open"]:
            return low.select(F.col("v").alias("id"), F.col("m").alias("component"))
        sent = join_per_key(cur, low.select("v", "m"), "v", low.select("v", "n"), measured=measured)
        out = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p")).select("p.v", "p.u")
        new = ws.write(out.distinct())
        ws.drop(cur, low)
        cur = new
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def named_numbers(df: DataFrame) -> DataFrame:
    """``(chp, people, low)``: the chapter number of each row or null, the tagged numbers of its speakers and authors, and the smallest of these or null."""

    def tagged(c, kind: int):
        return F.transform(c, lambda x: x + F.lit(kind * _SHIFT))

    people = F.concat(tagged(spelled_numbers(F.col("spk_id")), SPEAKER), tagged(spelled_numbers(F.col("author_id")), AUTHOR))
    return df.select(spelled_number(F.col("chp_id")).alias("chp"), people.alias("people")).select("chp", "people", F.array_min("people").alias("low"))


def chapter_groups(df: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``(chp_id bigint, group_id bigint, group_spk bigint)``: one row per chapter number.

    ``group_id`` is the smallest vertex of all that is tied to the chapter, ``group_spk`` the smallest speaker
    number among it or null. Rows without a chapter number tie, too; ids that spell no number tie nothing.

    A chapter is no vertex: it hangs on the smallest person of its rows, and where its rows differ in that, the others are tied
    to it. So the rounds run over speakers and authors only, and chapters get their group by one join.
    """
    ws = ws or Workspace(df.sparkSession, "chapters")
    rows = ws.write(named_numbers(df).where("chp IS NOT NULL OR low IS NOT NULL"))
    head = rows.where("chp IS NOT NULL").groupBy("chp").agg(F.min("low").alias("first"), F.max("low").alias("last"), F.count("low").alias("people"), F.count(F.lit(1)).alias("n"))
    head, measured = ws.write_with(head, **size_measures())
    within = rows.select(F.explode("people").alias("src"), F.col("low").alias("dst")).where("src <> dst")
    # two rows of a chapter are tied by their first and last person; only chapters of more rows are looked up again
    two = head.where("first < last").select(F.col("last").alias("src"), F.col("first").alias("dst"))
    more = ws.write(head.where("first < last AND people > 2").select("chp", "first"))
    across = join_per_key(rows.where("chp IS NOT NULL AND low IS NOT NULL").select("chp", "low"), more, "chp", head.select("chp", "n"), measured=measured)
    labels = hash_to_min(within.union(two).union(across.where("low <> first").select("low", "first")), ws).select(F.col("id").alias("first"), "component")
    out = join_per_key(head.select("chp", "first"), labels, "first", how="left")
    group = F.coalesce("component", "first", F.col("chp") + F.lit(CHAPTER * _SHIFT))
    out = out.select(F.col("chp").alias("chp_id"), group.alias("group_id"))
    return out.select("chp_id", "group_id", F.when(F.col("group_id") < _SHIFT, F.col("group_id")).alias("group_spk"))


def rendezvous(sizes: DataFrame, targets: dict[str, float], seed: int = 0, large: int = 1000) -> DataFrame:
    """``(group_id, split)`` for ``sizes(group_id, n)``: groups assigned whole, in nearly the given proportions.

    Weighted rendezvous hashing: a group goes to the split with the largest ``weight / -ln(u)``, u being the
    hash of seed, split and group in (0, 1), so for given weights the choice depends on nothing but the group, and a changed
    weight moves few groups. A group that holds more than 1/large of all records (at most ``large`` of them)
    can upset the proportions alone; these are placed first, largest first, each where most is missing, and
    the weights for the others are what is then still missing, so they move a little when the large groups or the total change.
    Weights must be positive and are normalised.
    """
    if not targets or any(not w > 0 for w in targets.values()):
        raise ValueError("every split needs a positive share")
    spark = sizes.sparkSession
    share = {k: w / sum(targets.values()) for k, w in targets.items()}
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at least 10 records: in a small table every group would count as large otherwise
    big = sizes.where((F.col("n") > total / large) & (F.col("n") >= 10)).orderBy(F.desc("n"), "group_id").collect()
    left = {k: s * total for k, s in share.items()}
    placed = []
    for g in big:
        k = max(left, key=lambda k: (left[k], k))
        left[k] -= g["n"]
        placed.append((g["group_id"], k))
    weights = {k: max(v, 0.0) for k, v in left.items()}
    if not any(weights.values()):
        weights = share
    names = [k for k in sorted(weights) if weights[k] > 0]

    def score(k: str):
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(k), F.col("group_id").cast("string"))), 1, 13), 16, 10).cast("bigint")
        u = (bits + 1) / F.lit(float((1 << 52) + 2))
        return F.struct((F.lit(weights[k]) / -F.log(u)).alias("s"), F.lit(k).alias("k"))

    best = F.greatest(*[score(k) for k in names])["k"] if len(names) > 1 else F.lit(names[0])
    first = spark.createDataFrame(placed, f"group_id {sizes.schema['group_id'].dataType.simpleString()}, _split string")
    return sizes.join(F.broadcast(first), "group_id", "left").select("group_id", F.coalesce("_split", best).alias("split"))


def related_splits(df: DataFrame, targets: dict[str, float], seed: int = 0) -> DataFrame:
    """``(chp_id, group_id, group_spk, split)``: every chapter number in a split, tied chapters in the same one.

    Chapters tied to nobody form a group of their own. An empty table gives no rows.
    """
    ws = Workspace(df.sparkSession, "splits")
    groups = ws.write(chapter_groups(df, ws))
    sizes = ws.write(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")))
    return join_per_key(groups, ws.write(rendezvous(sizes, targets, seed)), "group_id", sizes)
