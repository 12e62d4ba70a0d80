import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lithograph.functions.paths import owner_rules, owners_of, owners_united
from lithograph.plans import conflicts, context, payload, reviewers
from tests.seed import R, graph


def now(text="2026-03-10 00:00:00"):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def changed(spark, *rows):
    return spark.createDataFrame(list(rows), "pull_request_id string, ordinal int, repository_id string, path string, patch string")


def related_graph(spark):
    """Query files x and y; neighbours of similarity .9, .6 and .4 that share none, both and one of them."""
    vectors = {0: [1.0, 0.0], 1: [0.9, 0.19**0.5], 2: [0.6, 0.8], 3: [0.4, 0.84**0.5]}
    prs = [dict(id=f"n{i}", repository_id=R, number=i, title=f"t{i}", state="merged", author_id="ben" if i else "ada", embedding=v) for i, v in vectors.items()]
    files = [dict(id=f, repository_id=R, path=f"{f}.py", content_hash=f) for f in "xyu"]
    touched = {0: "xy", 1: "u", 2: "xy", 3: "x"}
    return graph(spark, pull_requests=prs, files=files, commits=[dict(id=f"k{i}", repository_id=R, sha=f"k{i}", message="", committed_at=datetime(2026, 1, 1)) for i in touched], pr_contains_commit=[dict(pull_request_id=f"n{i}", commit_id=f"k{i}") for i in touched], commit_modifies_file=[dict(id=f"t{i}{f}", commit_id=f"k{i}", file_id=f) for i, fs in touched.items() for f in fs])


def test_related_prs(spark):
    g = related_graph(spark)
    rows = context.related_prs(g, g["pull_requests"].where("id = 'n0'"), dim=2).orderBy("rank").collect()
    assert [r.number for r in rows] == [2, 1, 3]
    assert [r.score for r in rows] == pytest.approx([0.76, 0.54, 0.44])


def test_related_prs_drop_the_same_author_without_overlap(spark):
    g = related_graph(spark)
    g["pull_requests"] = g["pull_requests"].withColumn("author_id", F.lit("ada"))
    rows = context.related_prs(g, g["pull_requests"].where("id = 'n0'"), dim=2).collect()
    assert [r.number for r in rows] == [2]
    assert context.related_prs(g, g["pull_requests"].where("embedding is null"), dim=2).count() == 0


def test_adrs_are_filtered_after_the_nearest_are_taken(spark):
    adrs = [dict(id=f"d{i}", repository_id=R, path="p", title=t, status=s, embedding=[1.0, float(i)]) for i, (t, s) in enumerate([("a", "accepted"), (" ", "accepted"), ("c", "proposed"), ("d", "accepted")])]
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "id string, embedding array<float>")
    assert [r.title for r in context.relevant_adrs(graph(spark, adrs=adrs), asked, k=3, dim=2).collect()] == ["a"]


def test_history_issues_and_notes(spark):
    g = graph(spark, issues=[dict(id="i", repository_id=R, number=42, title="Bug", state="open")])
    files = changed(spark, ("p42", 0, R, "src/depot/crates.py", "+a\n" * 300 + "-b\n" * 300), ("p42", 1, R, "none.py", None))
    rows = context.recent_history(g, files, in_all=2).orderBy("place").collect()
    assert [(r.sha[0], r.title) for r in rows] == [("c", "third"), ("b", 'Revert "first"')]
    assert [(r.identifier, r.title) for r in context.linked_issues(g, g["pull_requests"]).collect()] == [("#42", "Bug")]
    notes = [r.note for r in context.risk_notes(g, files, now("2026-03-02 00:00:00"), churn=1).orderBy("place").collect()]
    assert notes == ["Large PR: the diff touches 600 lines across 2 file(s).", f"Recently reverted: src/depot/crates.py was touched by 1 revert commit(s) in the last 30 days ({'b' * 7}).", "High churn: src/depot/crates.py had 2 commits in the last 30 days."]
    assert context.risk_notes(g, files, now("2027-01-01 00:00:00"), large=600).count() == 0
    packet = json.loads(context.packets(g, g["pull_requests"], files, now("2026-03-02 00:00:00"), dim=4).first().packet)
    assert packet["narrative"] == "Packet assembled: 3 recent commit(s), 1 linked issue(s), 2 risk note(s)." and "related_adrs" not in packet and packet["linked_issues"][0]["state"] == "open"


@pytest.mark.parametrize("login, bot", [("dependabot[bot]", True), ("some-bot", True), ("github-actions", True), ("bot-carol", False), ("actions-user", False)])
def test_bots(spark, login, bot):
    assert spark.range(1).select(reviewers.is_bot(F.lit(login))).first()[0] is bot


def test_reviewers(spark):
    g = graph(spark, persons=[dict(id="x", github_login="x-bot"), dict(id="old", github_login="old")], commits=[dict(id="d", repository_id=R, sha="d", author_id="x", message="", committed_at=datetime(2026, 3, 1)), dict(id="e", repository_id=R, sha="e", author_id="old", message="", committed_at=datetime(2025, 11, 1))], commit_modifies_file=[dict(id="m8", commit_id="d", file_id="B"), dict(id="m7", commit_id="e", file_id="B")])
    prs = spark.createDataFrame([("p42", "ben")], "id string, author_login string")
    files = changed(spark, ("p42", 0, R, "src/depot/crates.py", None), ("p42", 1, R, "new.py", None))
    rules = owner_rules(spark.createDataFrame([(R, "src/depot/** @acme/depot-team @ada\n")], "repository_id string, content string"))
    pool = {r.login: r for r in reviewers.candidates(g, prs, files, now(), rules).collect()}
    assert set(pool) == {"acme/depot-team", "ada", "cleo"} and pool["acme/depot-team"].is_team and pool["ada"].person_id == "ada"
    found = {r.login: r for r in reviewers.ranked(g, prs, files, now(), rules).collect()}
    assert [r.login for r in sorted(found.values(), key=lambda r: r["rank"])] == ["ada", "acme/depot-team", "cleo"]
    assert found["ada"].score == pytest.approx(0.65) and found["ada"].rationale == "CODEOWNERS match for src/depot/crates.py."
    assert found["cleo"].score == pytest.approx(0.2) and found["cleo"].rationale == "Currently has capacity (0 open PRs)."
    signals = {r.login: r for r in reviewers.signals(g, reviewers.candidates(g, prs, files, now(), rules), files, now(), rules).collect()}
    assert signals["ada"].authorship_share == 0.5 and signals["cleo"].review_acceptance_rate == 1.0
    assert reviewers.candidates(g, prs, files, now()).count() == 2


def test_pools_of_many_pull_requests_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr("lithograph.operators.blocks.BLOCK_SETS", 2)
    # Two rows of persons share a login; the team is also known by a person's name; one owner is a bot.
    people = [("u0", "ann"), ("u1", "ann"), ("u2", "some-bot"), ("u3", "dan"), ("u4", "eve"), ("u5", "acme/depot-team")]
    commits = [dict(id=f"k{i}{j}", repository_id=R, sha=f"k{i}{j}", author_id=f"u{i}", message="", committed_at=datetime(2026, 3 if i != 3 else 1, 1)) for i in range(6) for j in range(3)]
    g = graph(
        spark, persons=[dict(id=i, github_login=n) for i, n in people], commits=commits, commit_modifies_file=[dict(id=f"t{c['id']}", commit_id=c["id"], file_id="AB"[n % 2]) for n, c in enumerate(commits) if n % 5],
        commit_modifies_symbol=[dict(commit_id=c["id"], symbol_id=["pac", "sta", "shi"][n % 3], change_kind="body_only") for n, c in enumerate(commits)], reviews=[dict(id=f"w{i}", pull_request_id="p42", reviewer_id=f"u{i}", state="approved", submitted_at=datetime(2026, 3, 2)) for i in range(1, 5)],
    )
    ids = [f"p{n}" for n in range(9)]
    prs = spark.createDataFrame([(p, [None, "ann", "dan"][n % 3]) for n, p in enumerate(ids)], "id string, author_login string")
    paths = ["src/depot/crates.py", "src/desk/orders.py", "new.py"]
    files = changed(spark, *[(p, k, R, path, None) for n, p in enumerate(ids) for k, path in enumerate(paths) if n >> k & 1])
    rules = owner_rules(spark.createDataFrame([(R, "*.py @zoe @dan @x[bot]\nsrc/depot/** @acme/depot-team @ann @acme/other\n")], "repository_id string, content string"))
    pool = reviewers.candidates(g, prs, files, now(), rules)
    # People and owners of a pull request are not gathered by an aggregation.
    assert "min(person_id" not in pool._jdf.queryExecution().executedPlan().toString()
    signals = reviewers.signals(g, pool, files, now(), rules)
    found = reviewers.weighed(g, prs, files, now(), rules)
    single, found = signals.withColumn("s", F.bround(reviewers.score(), 4)).collect(), found.collect()
    shown = [c for c in found[0].__fields__]
    assert sorted((tuple(r) for r in found), key=str) == sorted((tuple(r[c] for c in shown) for r in single), key=str) and len(found) > 20
    assert {(r.login, r.person_id, r.is_team) for r in found if r.pull_request_id == "p3"} >= {("acme/depot-team", "u5", True), ("acme/other", None, True), ("ann", "u0", False), ("eve", "u4", False)}
    first = {p: [r.login for r in sorted((r for r in single if r.pull_request_id == p and r.s > 0), key=lambda r: (-r.s, r.login))[:3]] for p in ids}
    ranked = reviewers.ranked(g, prs, files, now(), rules).collect()
    assert {p: [r.login for r in sorted((r for r in ranked if r.pull_request_id == p), key=lambda r: r["rank"])] for p in ids} == first


def test_overloaded_reviewers_fall_behind(spark):
    shape = "is_codeowner boolean, authorship_share double, recent_review_count int, call_graph_overlap int, review_acceptance_rate double, open_pr_load int"
    rows = spark.createDataFrame([(False, 0.5, 0, 0, 0.0, 12), (False, 0.5, 0, 0, 0.0, 1), (True, 1.0, 3, 1, 0.7, 9)], shape)
    assert [r[0] for r in rows.select(F.bround(reviewers.score(), 4)).collect()] == pytest.approx([0.05, 0.35, 0.7])


def test_conflicts_and_payload(spark):
    g = graph(spark, adrs=[dict(id="d", repository_id=R, path="docs/adr/1.md", title="One", status="accepted", embedding=[1.0, 0.0, 0.0, 0.0])])
    symbols = spark.createDataFrame([("p42", 0, R, "pack_crate", "modified", "def pack_crate(a): ...", "def pack_crate(a, b): ...", "src/depot/crates.py"), ("p42", 1, R, "find_order", "body_only", None, None, "src/desk/orders.py")], "pull_request_id string, ordinal int, repository_id string, qualified_name string, change_kind string, old_source string, new_source string, file_path string")
    files = spark.createDataFrame([("p42", "src/billing/a.py", "from x.exceptions import E", False), ("p42", "src/billing/b.py", "def pay() -> tuple[bool, str]: ...", True)], "key string, path string, content string, changed boolean")
    questions = conflicts.semantic_questions(g, symbols).collect()
    assert [(q.qualified_name, q.caller_name, q.classification) for q in questions] == [("pack_crate", "ship_crate", "signature_change")]
    judge = lambda df: df.withColumns({"is_conflict": F.lit(True), "severity": F.lit("blocking"), "title": F.lit("Breaks"), "detail": F.lit("d"), "suggested_action": F.lit("")})
    found = conflicts.conflicts(g, g["pull_requests"].select("id", "embedding"), symbols, files, "src/billing/", judge, judge, dim=4)
    assert sorted((r.kind, r.severity) for r in found.collect()) == [("architectural", "warning"), ("convention", "warning"), ("semantic", "blocking")]
    assert conflicts.conflicts(g, g["pull_requests"], symbols, files, "src/billing/").count() == 1
    twice = found.unionByName(found).unionByName(found.withColumn("kind", F.lit("reviewer_suggestion")))
    ranked = spark.createDataFrame([("p42", "a", 0.1, None, "r"), ("p42", "b", 0.9, None, "r"), ("p42", "c", 0.0, 1, "r")], "pull_request_id string, login string, score double, rank int, rationale string")
    review = json.loads(payload.payloads(g["pull_requests"], twice, reviewers=ranked, context=spark.createDataFrame([("p42", '{"a": 1}')], "pull_request_id string, packet string")).first().review)
    assert review["summary"] == "flagged 1 blocking, 2 warning." and [c["severity"] for c in review["conflicts"]] == ["blocking", "warning", "warning"]
    assert [r["login"] for r in review["suggested_reviewers"]] == ["c", "b", "a"] and review["context"] == {"a": 1} and "failed_agents" not in review
    assert payload.check_conclusion(found).first().conclusion == "action_required"
    empty = json.loads(payload.payloads(g["pull_requests"], found.limit(0)).first().review)
    assert empty == {"summary": "three checks ran and found nothing to flag.", "conflicts": []}


def test_callers_of_a_hub_are_cut_before_they_meet_its_changes(spark):
    g = graph(spark, symbols=[dict(id=f"h{i:02}", repository_id=R, file_id="A", qualified_name=f"hub{i:02}", kind="function", start_line=40 + i) for i in range(15)], symbol_calls=[dict(id=f"h{i}", caller_id=f"h{i:02}", callee_id="pac", line=i) for i in range(15)])
    symbols = spark.createDataFrame([(p, 1, R, "pack_crate", "deleted", None, None, "src/depot/crates.py") for p in ("p42", "p43")], "pull_request_id string, ordinal int, repository_id string, qualified_name string, change_kind string, old_source string, new_source string, file_path string")
    asked = conflicts.semantic_questions(g, symbols)
    assert sorted((r.pull_request_id, r.place, r.caller_name) for r in asked.collect()) == [(p, n + 1, f"hub{n:02}") for p in ("p42", "p43") for n in range(10)]
    # The rows that meet the changes are ten at most for a symbol, not all its callers.
    assert "windowspecdefinition(symbol_id" in asked._jdf.queryExecution().optimizedPlan().toString()


def test_coordinator_isolates_failures():
    def fail():
        raise ValueError("x")

    begun = time.monotonic()
    out = payload.coordinate({"good": lambda: 1, "bad": fail, "late": lambda: time.sleep(3)}, timeout=0.3)
    assert [(o.name, o.result is None) for o in out] == [("good", False), ("bad", True), ("late", True)] and time.monotonic() - begun < 2


def test_conventions_of_every_pull_request(spark):
    from lithograph.functions import queries

    text = "from app.exceptions import Bad\n\n\ndef pay(x) -> tuple[bool, str]:\n    return False, x\n"
    g = {**graph(spark), "source_texts": spark.createDataFrame([("B", text), ("A", text)], "file_id string, content string")}
    assert [(r.pull_request_id, r.title) for r in queries._PLANS["x9_convention_findings"](g).collect()] == [("p42", "Status tuple in pay")]
    row = queries._PLANS["c13_convention_payloads"](g).first()
    assert row.pull_request_id == "p42" and "Status tuple in pay" in row.review


def test_a_judge_that_fails_is_asked_once_more(spark):
    asked = []

    def judge(questions):
        asked.append(questions.count())
        if len(asked) == 1:
            raise ValueError("no answer")
        return questions.withColumn("is_conflict", F.lit(True))

    assert conflicts.asked_twice(judge)(spark.range(2)).count() == 2 and asked == [2, 2]
    with pytest.raises(ZeroDivisionError):
        conflicts.asked_twice(lambda df: 1 / 0)(spark.range(1))


def test_owners_of_the_last_rule_and_their_union(spark):
    rules = owner_rules(spark.createDataFrame([(R, "* @a\n/src/ @b @c mail@x.y\nsrc/*/x.py @d\n# no\nlonely\n"), ("none", None)], "repository_id string, content string"))
    paths = spark.createDataFrame([("p", R, p) for p in ("src/k/x.py", "src/k/l/x.py", "top", "src/y")] + [("p", "none", "z"), ("p", None, "z")], "pull_request_id string, repository_id string, path string")
    assert {r.path: r.owners for r in owners_of(paths, rules).collect()} == {"src/k/x.py": ["d"], "src/k/l/x.py": ["b", "c"], "top": ["a"], "src/y": ["b", "c"]}
    assert owners_united(paths, rules, "pull_request_id").first().owners == ["a", "b", "c", "d"]
    assert owners_of(paths.limit(0), rules).count() == 0
