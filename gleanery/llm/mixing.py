"""Mixing sources to target shares of the tokens.

Budgets run down a tree domain - language - source in proportion to the target shares; a
source's domain is the agency that most of its tokens come from, and its share is split
over the languages of its documents by their tokens, so it has a leaf in each.  What a leaf cannot fill with its documents, each used at most
``max_repeats`` times, goes to its siblings first, then to its language's and its
domain's siblings.  A target without documents is a leaf without room.  Each leaf's
budget is then filled from seeded epochs: whole epochs, and of the last one the first
documents of its shuffled order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.encoding import token_counts
from gleanery.storage import shared_table

#: Documents of a bucket on average: what one task orders.
BUCKET = 20_000


@dataclass
class Node:
    """A node of the budget tree; leaves are the documents of a source in one language."""

    name: str
    weight: float = 0.0
    room: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0


def spread(node: Node, budget: float) -> float:
    """Give ``budget`` to a node; returns what it has no room for."""
    node.budget = min(budget, node.room)
    if node.children:
        left, open_ = node.budget, [c for c in node.children if c.room > 0]
        for c in node.children:
            c.budget = 0.0
        while left > 1e-9 and open_:
            weight = sum(c.weight for c in open_)
            parts = [(c, left * (c.weight / weight if weight else 1 / len(open_))) for c in open_]
            full = [c for c, x in parts if c.budget + x >= c.room - 1e-9]
            if not full:
                for c, x in parts:
                    c.budget += x
                left = 0.0
            for c in full:
                left -= c.room - c.budget
                c.budget = c.room
            open_ = [c for c in open_ if c not in full]
        for c in node.children:
            spread(c, c.budget)
    return budget - node.budget


def tree(leaves: list[dict]) -> Node:
    """The tree of rows with domain, lang, source, weight and room."""
    root = Node("")
    for row in leaves:
        node = root
        node.weight, node.room = node.weight + row["weight"], node.room + row["room"]
        for level in ("domain", "lang", "source"):
            child = next((c for c in node.children if c.name == row[level]), None)
            if child is None:
                child = Node(row[level])
                node.children.append(child)
            child.weight, child.room = child.weight + row["weight"], child.room + row["room"]
            node = child
    return root


def _leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in _leaves(c)] if node.children else [node]


def language(lang):
    """One code per language from codes of varying form."""
    code = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.coalesce(code, F.lit("?"))


def largest_total(rows: list[dict]) -> int:
    """The largest total at which no leaf that has documents falls short."""
    unbounded = tree([r | {"room": float("inf") if r["room"] else 0.0} for r in rows])
    spread(unbounded, 1.0)
    parts = {id_: x.budget for id_, x in _placed(unbounded).items()}
    return int(min((r["room"] / parts[r["domain"], r["lang"], r["source"]] for r in rows if r["room"]), default=0))


def whole_supply(rows: list[dict]) -> int:
    """The tokens of all documents used once: sources whose share of it exceeds their repeats fall short."""
    return int(sum(r["tokens"] for r in rows))


def _placed(root: Node) -> dict[tuple[str, str, str], Node]:
    """The leaves by domain, language and source."""
    return {(d.name, x.name, s.name): s for d in root.children for x in d.children for s in x.children}


def mix(documents: DataFrame, targets: DataFrame, total: int | Callable[[list[dict]], int] = largest_total, seed: int = 7, tokenizer: str = "byte_bpe_50k", domains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, times) and the shares (one row per target source).

    ``total`` is the size of the mix in tokens, or a function of the leaves; by default the
    largest at which every source that has documents reaches its share within its repeats.
    ``targets`` is a table of settings, one row per source; it, ``domains`` (source, domain)
    for these sources, and one row per source and language of totals come to the driver.
    Sources that ``domains`` lacks have the ``metadata['agency']`` of most of their tokens
    as domain, or none.  Sources without target, null sources, and
    documents without tokens are left out; a source without documents passes its share to
    its domain's other sources, or if there are none, to all; repeated rows of a source in
    ``targets`` count once, with the largest share.  The last document is taken only if
    that brings the source nearer to its budget.
    """
    spark = documents.sparkSession
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goals = {r["source"]: r for r in wanted.collect()}
    listed = {r["source"]: r["domain"] for r in domains.where(F.col("source").isin(list(goals)) & F.col("domain").isNotNull()).groupBy("source").agg(F.min("domain").alias("domain")).collect()} if domains is not None else {}
    agency = F.col("metadata")["agency"] if "metadata" in documents.columns else F.lit(None).cast("string")
    sized = token_counts(documents.where(F.col("source").isin(list(goals))).withColumn("agency", agency), ["doc_id", "source", "lang", "agency"], tokenizer=tokenizer).where("n_tokens > 0 AND doc_id IS NOT NULL")
    sized = shared_table(sized.withColumn("lang", language(F.col("lang"))))
    facts = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()  # a row per target and language
    by_agency = sized.groupBy("source", "agency").agg(F.sum("n_tokens").alias("tokens"))
    top = by_agency.where("agency <> ''").groupBy("source").agg(F.max_by("agency", F.struct("tokens", "agency")).alias("domain"))
    leading = {r["source"]: r["domain"] for r in top.collect()} | listed  # a row per target
    have: dict[str, list] = {}
    for f in sorted(facts, key=lambda f: (f["source"], f["lang"])):
        have.setdefault(f["source"], []).append(f)

    rows = []
    for s, goal in sorted(goals.items()):
        own = {"domain": leading.get(s, ""), "source": s}
        whole = sum(f["tokens"] for f in have.get(s, []))
        for f in have.get(s, []):
            rows.append(own | {"lang": f["lang"], "weight": goal["target_share"] * f["tokens"] / whole, "tokens": f["tokens"], "room": float(f["tokens"] * goal["max_repeats"])})
        if s not in have:
            rows.append(own | {"lang": "", "weight": goal["target_share"], "tokens": 0, "room": 0.0})
    root = tree(rows)
    spread(root, float(total(rows) if callable(total) else total))
    leaves = {(s, lang): x.budget for (_, lang, s), x in _placed(root).items()}
    budgets = {s: sum(x for (name, _), x in leaves.items() if name == s) for s in goals}

    plan = [(f["source"], f["lang"], int((x := leaves[f["source"], f["lang"]]) // f["tokens"]), float(x % f["tokens"]), max(1, -(-int(f["docs"]) // BUCKET))) for fs in have.values() for f in fs]
    settings = spark.createDataFrame(plan, "source string, lang string, whole int, rest double, buckets int")
    keyed = sized.join(F.broadcast(settings), ["source", "lang"])  # a row per target and language
    # the order of the epoch after the whole ones: by a hash of seed, epoch and document, in buckets of that hash
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id")), 1)
    keyed = keyed.withColumn("draw", draw).withColumn("bucket", F.floor(F.col("draw").cast("double") / float(2**63) * F.col("buckets")).cast("int"))
    sums = keyed.groupBy("source", "lang", "bucket").agg(F.sum("n_tokens").alias("t"))
    past = Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(past), F.lit(0))).drop("t")
    within = Window.partitionBy("source", "lang", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(sums, ["source", "lang", "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    taken = F.when(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    chosen = placed.select("doc_id", "source", "n_tokens", (F.col("whole") + taken).cast("int").alias("times")).where("times > 0")
    chosen = shared_table(chosen)

    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("uses"), F.count(F.lit(1)).alias("documents"))
    most = {s: max(fs, key=lambda f: (f["tokens"], f["lang"]))["lang"] for s, fs in have.items()}
    told = [(s, leading.get(s), most.get(s), float(goals[s]["target_share"]), int(goals[s]["max_repeats"]), float(budgets[s])) for s in sorted(goals)]
    told = spark.createDataFrame(told, "source string, domain string, lang string, target_share double, max_repeats int, budget double")
    whole = reached.agg(F.sum("tokens").alias("all"))
    shares = told.join(reached, "source", "left").crossJoin(F.broadcast(whole))  # one row
    none = F.lit(0).cast("bigint")
    shares = shares.select("source", "domain", "lang", "target_share", "max_repeats", F.round("budget", 3).alias("budget"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("documents", none).alias("documents"), F.coalesce("uses", none).alias("uses"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"))
    return chosen, shares


def as_json(shares: DataFrame) -> str:
    """The shares as one JSON text, for reports."""
    return json.dumps([r.asDict() for r in shares.orderBy("source").collect()], ensure_ascii=False)
