"""Ranking reviewers for pull requests: candidates, signals, score and reason."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.paths import owners_of
from lithograph.operators import blocks
from lithograph.operators import graph as q
from lithograph.tables import checkpointed

WINDOW_DAYS, ACTIVE_DAYS, TOP = 180, 90, 3
# The weight of each signal and the value from which on it counts.
WEIGHTS = {"codeowner": 0.30, "authorship": 0.25, "reviews": 0.15, "overlap": 0.10, "acceptance": 0.10, "capacity": 0.10, "overload": -0.20}
SHARE, REVIEWS, OVERLAP, ACCEPTANCE, LOAD_LOW, LOAD_HIGH = 0.20, 3, 1, 0.70, 3, 8


def is_bot(login: Column) -> Column:
    """Whether a login is an automation account, by its suffix and case."""
    return login.endswith("-bot") | login.endswith("-actions") | login.endswith("[bot]")


def _before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def _files(g: q.Graph, changed: DataFrame) -> DataFrame:
    return changed.select("pull_request_id", "repository_id", "path").distinct().join(q.file_by_path(g, changed), ["repository_id", "path"])


def _owners(files: DataFrame, rules: DataFrame | None) -> DataFrame:
    if rules is None:
        return files.select("pull_request_id", "path", F.lit("").alias("login")).limit(0)
    owned = owners_of(files.select("repository_id", "path"), rules)
    return files.join(owned, ["repository_id", "path"]).select("pull_request_id", "path", F.explode("owners").alias("login"))


@dataclass(frozen=True)
class Evidence:
    """What candidates and signals both start from: known files, and who wrote and reviewed them lately."""

    files: DataFrame
    authors: DataFrame
    reviews: DataFrame


def evidence(g: q.Graph, changed: DataFrame, now: Column, kept: bool = False) -> Evidence:
    """The evidence on changed files; ``kept`` writes it once for several uses."""
    keep = checkpointed if kept else lambda df: df
    files = keep(_files(g, changed))
    since, asked = _before(now, WINDOW_DAYS), files.select("file_id").distinct()
    return Evidence(files, keep(q.authors_of_file(g, since, asked)), keep(q.reviewers_of_file(g, since, asked)))


def candidates(g: q.Graph, prs: DataFrame, changed: DataFrame, now: Column, rules: DataFrame | None = None, known: Evidence | None = None) -> DataFrame:
    """pull_request_id, login, person_id, is_team: owners, recent authors and recent reviewers of the changed files.

    The author of the pull request, bots, and people whose last activity is
    older than 90 days or unknown drop out; teams and owners who are neither
    recent authors nor reviewers, so that nothing tells who they are, stay.
    ``prs`` has id, author_login.
    """
    return _pool(g, prs, changed, now, rules, known)


_PLAIN = {"pull_request_id": pa.string(), "login": pa.string(), "person_id": pa.string(), "is_team": pa.bool_()}
_WEIGHED = _PLAIN | {"is_codeowner": pa.bool_()} | dict.fromkeys(("n_paths", "authored", "recent_review_count", "call_graph_overlap", "approved", "total", "open_pr_load"), pa.int64())
_FILES = {"authored_files": pa.list_(pa.string())}


def _pool(g: q.Graph, prs: DataFrame, changed: DataFrame, now: Column, rules: DataFrame | None, known: Evidence | None, weighed: bool = False, top: int | None = None) -> DataFrame:
    """Candidates, with what their signals are made of if ``weighed``; with ``top``, of each pull request at least the best.

    A busy file makes most people candidates for each pull request that touches
    it, so their pairs are found in blocks of pull requests and never shuffled.
    """
    changed = changed if known else checkpointed(changed)
    seen = known or evidence(g, changed, now, kept=True)
    since, paths = _before(now, WINDOW_DAYS), changed.select("pull_request_id", "repository_id", "path").distinct()
    count, block = blocks.blocks_of(changed, "pull_request_id")
    sets = changed.groupBy("pull_request_id").agg(F.count_distinct("path").alias("n_paths")).join(prs.select(F.col("id").alias("pull_request_id"), "author_login").distinct(), "pull_request_id")
    placed = seen.files.select(block, "pull_request_id", "path", "file_id")
    asked = placed.select("block", "file_id").distinct()
    people = g["persons"].select(F.col("id").alias("person_id"), F.col("github_login").alias("login")).where(~is_bot(F.col("login")))
    active = F.coalesce(F.col("last_at") >= _before(now, ACTIVE_DAYS), F.lit(False)).cast("long")
    ids = people.select("person_id")
    facts = people.join(q.last_activity_at(g, ids), "person_id", "left")
    if weighed:
        facts = facts.join(q.review_acceptance_rate(g, since, ids), "person_id", "left").join(q.open_prs_assigned_to(g, ids), "person_id", "left").select("person_id", "login", F.array(active, "approved", "total", "n").alias("facts"))
    else:
        facts = facts.select("person_id", "login", F.array(active).alias("facts"))
    people = checkpointed(facts.withColumn("person", F.monotonically_increasing_id()))
    numbers = people.select("person_id", "person")
    worked = lambda df: asked.join(df.join(numbers, "person_id").groupBy("file_id").agg(F.collect_list(F.struct("person", "n")).alias("w")), "file_id")
    both = {"file_id": F.col("file_id"), "longs": F.col("w.person"), "more": F.col("w.n")}
    parts = [
        blocks.part(sets.withColumn("block", block), blocks.SET, name=F.col("pull_request_id"), other=F.col("author_login"), key=F.col("n_paths")),
        blocks.part(placed, blocks.FILE, name=F.col("pull_request_id"), other=F.col("path"), file_id=F.col("file_id")),
        blocks.part(worked(seen.authors), blocks.AUTHORS, **both), blocks.part(worked(seen.reviews), blocks.REVIEWS, **both),
        blocks.part(blocks.to_all(people, count), blocks.PERSON, key=F.col("person"), name=F.col("person_id"), other=F.col("login"), longs=F.col("facts")),
    ]
    if rules is not None:
        # Owners of every changed path count here, also of those the graph does not know; the owner signal looks at known ones only.
        owned = paths.join(owners_of(paths.select("repository_id", "path"), rules), ["repository_id", "path"]).join(seen.files.select("pull_request_id", "repository_id", "path", F.lit(1).alias("known")), ["pull_request_id", "repository_id", "path"], "left")
        owners = owned.select("pull_request_id", F.explode("owners").alias("login"), "known").where(~is_bot(F.col("login"))).groupBy("pull_request_id", "login").agg(F.coalesce(F.max("known"), F.lit(0)).alias("known"))
        parts.append(blocks.part(owners.withColumn("block", block), blocks.OWNER, name=F.col("pull_request_id"), other=F.col("login"), key=F.col("known")))
    if weighed:
        near, touched = q.neighbours_changed(g, seen.files, since)
        parts += blocks.overlap_parts(near, touched.join(numbers, "person_id").select("symbol_id", "person"), asked, count)
    fields = pa.schema(_PLAIN if not weighed else _WEIGHED if top is None else _WEIGHED | _FILES)
    answer = lambda rows: _answered(rows, fields, weighed, top)
    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "long", pa.list_(pa.string()): "array<string>"}
    return blocks.answered(parts, count, answer, ", ".join(f"{f.name} {kinds[f.type]}" for f in fields))


def _answered(rows: blocks.Rows, fields: pa.Schema, weighed: bool, top: int | None) -> Iterator[pa.RecordBatch]:
    """The candidates of each pull request of a block, people before owners that no person is known for."""
    people = rows[blocks.PERSON].sort_by([("other", "ascending"), ("name", "ascending")])
    numbers, logins, ids = people.column("key").to_numpy(), people.column("other").combine_chunks(), people.column("name").combine_chunks()
    order = np.argsort(numbers)
    size = len(numbers)
    facts = blocks.lists(people.column("longs"))[0].reshape(size, -1)
    # People in the order of their logins and then ids; those of one login are one candidate, the first of them.
    code = np.cumsum(np.diff(logins.dictionary_encode().indices.to_numpy(), prepend=-1) != 0) if size else np.empty(0, np.int64)
    code_of = dict(zip(logins.to_pylist(), code.tolist(), strict=True))

    def by_file(kind: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        who, at = blocks.lists(rows[kind].column("longs"))
        who, n = order[np.searchsorted(numbers[order], who)], blocks.lists(rows[kind].column("more"))[0]
        return {f: (who[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for i, f in enumerate(rows[kind].column("file_id").to_pylist())}

    def by_set(kind: int, *columns: str) -> dict[str, list[tuple]]:
        out = defaultdict(list)
        for one, *rest in zip(*[rows[kind].column(c).to_pylist() for c in ("name", *columns)], strict=True):
            out[one].append(tuple(rest))
        return out

    wrote, reviewed = by_file(blocks.AUTHORS), by_file(blocks.REVIEWS)
    files, owners = by_set(blocks.FILE, "other", "file_id"), by_set(blocks.OWNER, "other", "key")
    overlap = blocks.Overlap(rows, numbers[order]) if weighed else None
    for one, ((author, n_paths), *_) in by_set(blocks.SET, "other", "key").items():
        authored, reviews = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, file in files[one]:
            if file in wrote:
                authored[wrote[file][0]] += 1
            if file in reviewed:
                reviews[reviewed[file][0]] += reviewed[file][1]
        there = np.flatnonzero((authored > 0) | (reviews > 0))
        who = there[np.diff(code[there], prepend=-1) != 0]
        team, owner, alone = np.zeros(len(who), bool), np.zeros(len(who), bool), []
        for login, known in owners[one]:
            at = int(np.searchsorted(code[who], code_of.get(login, -1)))
            if at < len(who) and code[who[at]] == code_of.get(login, -1):
                team[at], owner[at] = "/" in login, bool(known)
            elif login != author:
                alone.append((login, bool(known)))
        kept = ((facts[who, 0] > 0) | team) & (code[who] != code_of.get(author, -1))
        who, team, owner = who[kept], team[kept], owner[kept]
        columns = {"is_team": team, "is_codeowner": owner}
        if weighed:
            near = np.empty(size, np.int64)
            near[order] = overlap.of([f for _, f in files[one]])
            columns |= {"n_paths": np.full(len(who), n_paths), "authored": authored[who], "recent_review_count": reviews[who], "call_graph_overlap": near[who], "approved": facts[who, 1], "total": facts[who, 2], "open_pr_load": facts[who, 3]}
        if top is not None:
            # People stand in the order of their logins, so equal scores keep it.
            best = np.sort(np.argsort(-_scores(columns), kind="stable")[:top])
            who, columns = who[best], {c: x[best] for c, x in columns.items()}
        out = {"pull_request_id": pa.repeat(pa.scalar(one, pa.string()), len(who) + len(alone)), "login": logins.take(pa.array(who)), "person_id": ids.take(pa.array(who)), **{c: pa.array(x) for c, x in columns.items()}}
        if top is not None:
            out["authored_files"] = pa.array([sorted({p for p, f in files[one] if f in wrote and w in wrote[f][0]}) for w in who.tolist()], pa.list_(pa.string()))
        if alone:
            rest = {"login": [x for x, _ in alone], "person_id": [None] * len(alone), "is_team": ["/" in x for x, _ in alone], "is_codeowner": [x for _, x in alone], "n_paths": [n_paths] * len(alone), "authored_files": [[]] * len(alone)}
            out = {f.name: out[f.name] if f.name == "pull_request_id" else pa.concat_arrays([out[f.name], pa.array(rest.get(f.name, [0] * len(alone)), f.type)]) for f in fields}
        if len(out["pull_request_id"]):
            yield pa.RecordBatch.from_arrays([out[f.name] for f in fields], schema=fields)


def _scores(c: dict[str, np.ndarray]) -> np.ndarray:
    """``score`` of many people at once, rounded as there."""
    share, rate = c["authored"] / np.maximum(c["n_paths"], 1), c["approved"] / np.maximum(c["total"], 1)
    conditions = {"codeowner": c["is_codeowner"], "authorship": share >= SHARE, "reviews": c["recent_review_count"] >= REVIEWS, "overlap": c["call_graph_overlap"] >= OVERLAP, "acceptance": rate >= ACCEPTANCE, "capacity": c["open_pr_load"] < LOAD_LOW, "overload": c["open_pr_load"] > LOAD_HIGH}
    total = np.zeros(len(share))
    for name, condition in conditions.items():
        total = total + np.where(condition, WEIGHTS[name], 0.0)
    return np.round(total, 4)


def _divided(rows: DataFrame, *more: str) -> DataFrame:
    share, rate = (F.coalesce(F.try_divide(a, b), F.lit(0.0)) for a, b in (("authored", "n_paths"), ("approved", "total")))
    return rows.select("pull_request_id", "login", "person_id", "is_team", "is_codeowner", share.alias("authorship_share"), "recent_review_count", "call_graph_overlap", rate.alias("review_acceptance_rate"), "open_pr_load", F.col("total").alias("total_reviews"), *more)


def weighed(g: q.Graph, prs: DataFrame, changed: DataFrame, now: Column, rules: DataFrame | None = None) -> DataFrame:
    """C7 and C8 in one: all candidates with their six signals."""
    return _divided(_pool(g, prs, changed, now, rules, None, weighed=True))


def signals(g: q.Graph, pool: DataFrame, changed: DataFrame, now: Column, rules: DataFrame | None = None, known: Evidence | None = None) -> DataFrame:
    """``pool`` with the six signals; whatever is unknown counts as none.

    The share of authored files is of all changed paths, known or not; the
    owner signal looks at known ones only.
    """
    seen = known or evidence(g, changed, now)
    files, since = seen.files, _before(now, WINDOW_DAYS)
    owner = _owners(files, rules).select("pull_request_id", "login", F.lit(True).alias("is_codeowner")).distinct()
    paths = changed.groupBy("pull_request_id").agg(F.count_distinct("path").alias("n_paths"))
    authored = files.join(seen.authors, "file_id").groupBy("pull_request_id", "person_id").agg(F.count_distinct("path").alias("authored"), F.sort_array(F.collect_set("path")).alias("authored_files"))
    reviewed = files.join(seen.reviews, "file_id").groupBy("pull_request_id", "person_id").agg(F.sum("n").alias("recent_review_count"))
    overlap = q.call_graph_overlap_counts(g, files.select(F.col("pull_request_id").alias("set_id"), "file_id"), since).select(F.col("set_id").alias("pull_request_id"), "person_id", F.col("n").alias("call_graph_overlap"))
    people = pool.where(F.col("person_id").isNotNull()).select("person_id").distinct()
    rate = q.review_acceptance_rate(g, since, people)
    load = q.open_prs_assigned_to(g, people).withColumnRenamed("n", "open_pr_load")
    both = ["pull_request_id", "person_id"]
    rows = pool.join(owner, ["pull_request_id", "login"], "left").join(paths, "pull_request_id", "left").join(authored, both, "left").join(reviewed, both, "left").join(overlap, both, "left").join(rate, "person_id", "left").join(load, "person_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "pull_request_id", "login", "person_id", "is_team", F.coalesce("is_codeowner", F.lit(False)).alias("is_codeowner"),
        F.coalesce(F.try_divide("authored", "n_paths"), F.lit(0.0)).alias("authorship_share"), F.coalesce("recent_review_count", zero).alias("recent_review_count"), F.coalesce("call_graph_overlap", zero).alias("call_graph_overlap"),
        F.coalesce(F.try_divide("approved", "total"), F.lit(0.0)).alias("review_acceptance_rate"), F.coalesce("open_pr_load", zero).alias("open_pr_load"), F.coalesce("total", zero).alias("total_reviews"), F.coalesce("authored_files", F.array().cast("array<string>")).alias("authored_files"),
    )


def score() -> Column:
    """The sum of the weights of all signals that count, in a fixed order."""
    c = F.col
    conditions = {"codeowner": c("is_codeowner"), "authorship": c("authorship_share") >= SHARE, "reviews": c("recent_review_count") >= REVIEWS, "overlap": c("call_graph_overlap") >= OVERLAP, "acceptance": c("review_acceptance_rate") >= ACCEPTANCE, "capacity": c("open_pr_load") < LOAD_LOW, "overload": c("open_pr_load") > LOAD_HIGH}
    total = F.lit(0.0)
    for name, condition in conditions.items():
        total = total + F.when(condition, WEIGHTS[name]).otherwise(0.0)
    return total


def rationale() -> Column:
    """The strongest reason for a candidate, in one sentence."""
    c = F.col
    percent = lambda x: F.bround(x * 100).cast("int").cast("string")
    number = lambda name, one, many: F.concat(c(name).cast("string"), F.when(c(name) == 1, F.lit(one)).otherwise(F.lit(many)))
    busy = c("recent_review_count") >= REVIEWS
    # The sentences.
    return (
        F.when(c("is_codeowner") & (F.size("authored_files") > 0), F.concat(F.lit("CODEOWNERS match for "), F.try_element_at("authored_files", F.lit(1)), F.lit(".")))
        .when(c("is_codeowner"), F.lit("CODEOWNERS match for the files touched by this PR."))
        .when(c("authorship_share") >= SHARE, F.concat(F.lit("Authored "), percent(c("authorship_share")), F.lit("% of touched files in the last 6 months.")))
        .when(c("call_graph_overlap") >= OVERLAP, F.concat(F.lit("Recently modified "), number("call_graph_overlap", " symbol", " symbols"), F.lit(" that call into this PR's code.")))
        .when(busy & (c("total_reviews") > 0) & (c("review_acceptance_rate") >= ACCEPTANCE), F.concat(F.lit("Reviewed "), c("recent_review_count").cast("string"), F.lit(" PRs in this area with a "), percent(c("review_acceptance_rate")), F.lit("% acceptance rate.")))
        .when(busy, F.concat(F.lit("Reviewed "), c("recent_review_count").cast("string"), F.lit(" PRs touching these files recently.")))
        .when(c("open_pr_load") < LOAD_LOW, F.concat(F.lit("Currently has capacity ("), number("open_pr_load", " open PR", " open PRs"), F.lit(").")))
        .when(c("is_team"), F.concat(F.lit("Listed as a team owner ("), c("login"), F.lit(").")))
        .otherwise(F.lit("Surfaced by historical review activity near this PR."))
    )


def ranked(g: q.Graph, prs: DataFrame, changed: DataFrame, now: Column, rules: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """The best reviewers of each pull request with score, rank and reason; a score of 0 or less is no suggestion."""
    scored = _divided(_pool(g, prs, changed, now, rules, None, weighed=True, top=top), "authored_files").withColumn("score", F.bround(score(), 4))
    place = F.row_number().over(W.partitionBy("pull_request_id").orderBy(F.desc("score"), "login"))
    return scored.where(F.col("score") > 0).withColumn("rank", place).where(F.col("rank") <= top).select("pull_request_id", "login", "is_team", "score", "rank", rationale().alias("rationale"))
