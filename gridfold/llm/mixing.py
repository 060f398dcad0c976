"""Mixing sources to target weights: integer block quotas by highest quotients, dealt to shards.

Tokens of a source form one stream: documents in seeded order, then runs of neighbouring words in
a seeded permutation, gone round as often as needed.  Sainte-Lague apportionment says how many
equal-token blocks each source gives, and each shard gets an integer quota of them; block i of a
source is words [i * block, (i + 1) * block) of its stream.  Everything is a function of a few
numbers per source and shard, so no block is ever listed.  DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import numbered, running_total, word_count, word_pieces
from gridfold.session import cut

PASSES = 3  # how often a word may be taken at most
ROUNDS = 24  # of the swap-or-not shuffle of runs
SHARDS = 16
RUN = 256  # blocks that stay together, so that documents mostly stay whole


def source_targets(sizes: DataFrame, weights: tuple[float, ...], ceiling: int = PASSES) -> DataFrame:
    """``key, source_size`` -> plus ``rank, weight, target``.

    Sources in key order weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``ceiling`` times its source's size and the excess is shared again by weight until
    none is above.  Each round is one aggregate of the source table.
    """
    ranked = numbered(sizes, ["key"], "rank")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * float(ceiling))
    ranked = cut(ranked)
    level, before = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("weight") * level if before >= 0 else F.lit(False)
        got = ranked.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("_cap"))).alias("capped"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == before or not got["total"] or not got["open"]:
            break
        before, level = got["n"], (got["total"] - (got["capped"] or 0.0)) / got["open"]
    return ranked.withColumn("target", F.least("_cap", F.col("weight") * level)).drop("_cap")


def block_quotas(targets: DataFrame, block: int) -> DataFrame:
    """Add ``blocks`` by Sainte-Lague: the round(total / block) highest quotients target / (2k - 1).

    The common divisor of the final seats lies between total / (seats + s/2) and
    total / (seats - s/2) for s sources.  Seats that the larger divisor grants are sure; only the
    few between the two (at most four a source on average) are ranked.
    """
    got = targets.agg(F.sum(F.col("target").cast("decimal(30,6)")).alias("v"), F.count("*").alias("s")).first()  # exact, in whatever order
    v, s = float(got["v"] or 0.0), int(got["s"])
    seats = round(v / block)
    if not seats:
        return targets.withColumn("blocks", F.lit(0).cast("long"))
    t = F.col("target")
    sure = F.greatest(F.lit(0), F.floor(t * ((seats - s / 2) / v) - 0.5)) if seats > s / 2 else F.lit(0)
    most = F.ceil(t * ((seats + s / 2) / v) + 1.5)
    spans = cut(targets.withColumn("_sure", sure.cast("long")).withColumn("_most", F.when(t > 0, most).otherwise(0).cast("long")))
    left = seats - int(spans.agg(F.sum("_sure").alias("n")).first()["n"])
    contested = spans.where("_most > _sure").select("rank", "target", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    contested = contested.select("rank", (-F.col("target") / (2 * F.col("_k") - 1)).alias("_quotient"))
    won = numbered(contested, ["_quotient", "rank"], "_n").where(F.col("_n") < left).groupBy("rank").agg(F.count("*").alias("_won"))
    return (spans.join(won, "rank", "left").withColumn("blocks", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_most", "_won"))


def shard_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``rank, shard, blocks``: each source's blocks over shards, at most one apart, with the odd
    blocks dealt on from source to source so that shard totals differ by at most one.  ``from``
    is the first of the shard's blocks in the source's stream."""
    odd = F.col("blocks") % shards
    dealt = running_total(quotas.withColumn("_odd", odd).withColumn("_one", F.lit(0)).withColumn("_order", F.shiftleft(F.col("rank"), 30)), "_one", "_order", "_odd", "_dealt")
    per = dealt.select("rank", F.expr(f"blocks div {shards}").alias("_base"), "_odd", "_dealt", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    turn = (F.col("shard") - F.col("_dealt") % shards + shards) % shards  # how far the shard is behind the dealer
    start = F.col("_dealt") % shards
    before = F.greatest(F.lit(0), F.least(F.col("shard"), start + F.col("_odd")) - start) + F.greatest(F.lit(0), F.least(F.col("shard"), start + F.col("_odd") - shards))
    return per.select("rank", "shard", (F.col("_base") + (turn < F.col("_odd")).cast("long")).alias("blocks"),
                      (F.col("_base") * F.col("shard") + before).alias("from"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))  # null after every source


def shuffled(place: Column, salts: Column, n: Column) -> Column:
    """Where ``place`` of 0..n-1 goes in the swap-or-not shuffle (Hoang, Morris, Rogaway 2012): in
    each round a place changes with its mirror image if a hash of the larger of both says so.  A
    bijection for every n, without cycle walking."""
    def turn(x, salt):
        mirror = F.pmod(F.pmod(salt, n) - x, n)
        return F.when(F.xxhash64(salt, F.greatest(x, mirror)).bitwiseAND(1) == 1, mirror).otherwise(x)
    return F.aggregate(salts, place.cast("long"), turn)


def plan_mix(docs: DataFrame, weights: tuple[float, ...], block: int, seed: int = 0, keep: tuple[str, ...] = (), shards: int = SHARDS, run: int = RUN) -> DataFrame:
    """Every document with what the mix takes of it: doc_id, source, size, source_size, target,
    ``pieces`` (array of pass, first, last, shard: words [first, last) of the document, in order
    of pass and words; neighbours of one pass and shard are one piece), and the columns of ``keep``.

    Sizes are words; null texts have size 0 and no pieces.  Null sources form one source, last in
    order.  An empty table gives no rows.  Equal rows are interchangeable.  A document's work
    grows with its own length, at ``block * run`` words a step.
    """
    base = docs.select("doc_id", "source", word_count("text").alias("size"), _key().alias("key"),
                       F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_hash"), *[c for c in keep if c not in ("doc_id", "source")])
    targets = source_targets(base.groupBy("key").agg(F.sum("size").alias("source_size")), weights)
    quotas = cut(block_quotas(targets, block))
    borders = shard_quotas(quotas, shards).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "from"))).alias("_shards"))  # ``shards`` entries a source
    borders = borders.select("rank", F.transform("_shards", lambda s: s["from"] * block).alias("_borders"))
    want = F.least(F.col("blocks") * block, F.col("source_size") * PASSES)
    salts = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.xxhash64(F.lit(seed), F.col("key"), i))
    per = cut(quotas.join(borders, "rank").select("key", "source_size", "target", want.alias("_want"), "_borders", salts.alias("_salts")))
    placed = running_total(base, "key", "_hash", "size", "_from").join(per, "key")
    step = block * run
    whole = F.floor(F.col("source_size") / step)  # runs that are permuted; the rest of the stream stays last

    def part(i):
        head = i * step
        first = F.greatest(F.lit(0).cast("long"), head - F.col("_from"))
        at = F.when(i < whole, shuffled(i, F.col("_salts"), whole)).otherwise(i) * step + F.col("_from") + first - head
        return F.struct(first.alias("first"), F.least(F.col("size"), head + step - F.col("_from")).alias("last"), at.alias("at"))

    runs = F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_from") + F.col("size") - 1) / step))
    placed = placed.withColumn("_parts", F.when(F.col("size") > 0, F.transform(runs, part)).otherwise(F.expr("array()")))

    def shard_of(word):  # the last border at or before the word: shards without blocks share theirs with the next
        return F.size(F.filter("_borders", lambda b: b <= word)) - 1

    def taken(k):
        def cut_at_borders(p):
            begin = p["at"] + k * F.col("source_size")
            end = F.least(F.col("_want"), begin + p["last"] - p["first"])
            def inside(s):
                low = F.greatest(begin, F.element_at("_borders", (s + 1).cast("int")))
                high = F.when(s + 1 < shards, F.least(end, F.element_at("_borders", F.least(s + 2, F.lit(shards)).cast("int")))).otherwise(end)
                return F.struct(F.lit(k).alias("pass"), (p["first"] + low - begin).alias("first"), (p["first"] + high - begin).alias("last"), s.alias("shard"))
            cuts = F.transform(F.sequence(shard_of(begin), shard_of(end - 1)), inside)
            return F.when(end > begin, F.filter(cuts, lambda c: c["last"] > c["first"]))
        return F.flatten(F.filter(F.transform("_parts", cut_at_borders), lambda c: c.isNotNull()))

    placed = placed.withColumn("_cuts", F.concat(*[taken(k) for k in range(PASSES)]))
    return (placed.withColumn("pieces", _joined(F.col("_cuts")))
            .drop("_hash", "_from", "key", "_want", "_borders", "_salts", "_parts", "_cuts"))


def _joined(cuts: Column) -> Column:
    """Neighbouring pieces of one pass and shard as one."""
    def apart(a, b):
        return (a["pass"] != b["pass"]) | (a["shard"] != b["shard"]) | (a["last"] != b["first"])
    n = F.size(cuts)
    heads = F.filter(cuts, lambda c, i: (i == 0) | apart(F.get(cuts, i - 1), c))
    tails = F.filter(cuts, lambda c, i: (i == n - 1) | apart(c, F.get(cuts, i + 1)))
    return F.zip_with(heads, tails, lambda h, t: F.struct(h["pass"].alias("pass"), h["first"].alias("first"), t["last"].alias("last"), h["shard"].alias("shard")))


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = 16, seed: int = 0, shards: int = SHARDS, run: int = RUN) -> DataFrame:
    """doc_id, size, source_size, target, taken: words taken of each document, repeats counted;
    shard_words: the words each shard takes of it (array of shard, words, by shard).

    A source's words sum to its quota of blocks, at most half a block or so off its target; its
    shards differ by at most one block; no document gives more than three times its size.
    """
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"])
    mine = F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    per = F.transform(mine, lambda s: F.struct(s.alias("shard"), F.aggregate(F.filter("pieces", lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"]).alias("words")))
    return plan_mix(docs, weights, block, seed, (), shards, run).select("doc_id", "size", "source_size", "target", words.alias("taken"), per.alias("shard_words"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = 16, seed: int = 0, shards: int = 1, run: int = RUN, shard_as: str | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document appears once for each pass that
    takes it; where a taken run or a shard starts or ends inside it, only the words taken stay
    (``n_chars``, if there, counts the characters that stayed).  Documents without words are kept
    once.  ``shard_as`` names a further column for the shard (null without words)."""
    names = docs.columns
    inner = {c: c if c in ("doc_id", "source", "text") else f"_own{i}" for i, c in enumerate(names)}  # no clash with the plan's columns
    planned = plan_mix(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), weights, block, seed, tuple(inner.values()), shards, run)
    nothing = F.struct(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.lit(None).cast("int").alias("shard"))
    planned = planned.withColumn("_span", F.explode(F.when(F.col("size") == 0, F.array(nothing)).otherwise(F.col("pieces"))))
    part = F.array_join(F.slice(word_pieces(F.col("text")), (F.col("_span.first") + 1).cast("int"), (F.col("_span.last") - F.col("_span.first")).cast("int")), "")
    whole = (F.col("_span.first") == 0) & (F.col("_span.last") == F.col("size"))
    columns = {c: F.col(n) for c, n in inner.items()}
    columns["text"] = F.when(whole, F.col("text")).otherwise(part)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.length(part).cast("long"))
    if shard_as:
        columns[shard_as] = F.col("_span.shard")
    return planned.select(*[v.alias(c) for c, v in columns.items()])
