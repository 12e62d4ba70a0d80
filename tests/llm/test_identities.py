import pytest

from lithograph.llm import identities

PEOPLE = [
    ("a1", "anna-zelkova", "Anna Zelkova", "anna.zelkova@corp.example"), ("a2", "zelkovaa", "ZELKOVA Anna", " <Anna.Zelkova+ci@mail.corp.example>"), ("a3", "brave-otter12", "Unknown", "ANNA.ZELKOVA@CORP.EXAMPLE"), ("a4", "azelkova", "Zelkova, Anna (she/her)", None),
    ("a5", "anna-zelkova2", "Ana Zelkova", "123+anna-zelkova2@users.noreply.forge.example"), ("a6", "anna-z", "Anna Zelkkova", "misty.fox99@other.test"), ("a7", "zelkova", "Anna ZelkovÃ¡", "zelkova.anna@newjob.test"),
    ("b1", "leonmarunten", "Leon Marunten", "leon.marunten@corp.example"), ("b2", "leona-marunten", "Leona Marunten", "leona.marunten@corp.example"),
    ("c1", "fox1", "Greta Polister", "greta.polister@corp.example"), ("c2", "fox2", "Greta Polister", "greta.polister2@corp.example"),
    ("d1", "x-y-11[bot]", None, "ci@corp.example"), ("d2", "z-11-bot", None, "ci@corp.example"), ("e1", "ops-one", None, "ops@corp.example"), ("e2", "opstwo", None, "ops@corp.example"),
    ("f1", "w-vandorf", "William Vandorf", "william.vandorf@corp.example"), ("f2", "bill-vandorf", "Bill Vandorf", ""), ("f3", "vandorf", "W. Vandorf", None),
    ("g1", "kestrin-ute", "Ute Kestrin", None), ("g2", "utekestrin", "Kestrin, Ute", ""), ("n", None, None, None), ("a1", "anna-zelkova", "Anna Zelkova", "anna.zelkova@corp.example"), (None, "q", "q", "q@q.example"),
]


@pytest.fixture(scope="module")
def groups(spark):
    more = [(f"m{i}", f"{g}-fam{i}ily", f"{g.capitalize()} Fam{c}ily", f"{g}.fam{c}ily@corp.example") for i, (g, c) in enumerate((g, c) for g in ("anna", "leon", "leona", "greta", "ute") for c in "bcdf")]
    df = spark.createDataFrame([(*p, "x") for p in [*PEOPLE, *more]], "id string, github_login string, name string, email string, person string")
    rows = identities.linked(df).collect()
    assert len(rows) == len({r.id for r in rows})
    out = {}
    for r in rows:
        out.setdefault(r.person, set()).add(r.id)
    return {frozenset(v) for v in out.values() if not all(i.startswith("m") for i in v)}


def test_one_person_under_many_spellings(groups):
    assert frozenset({"a1", "a2", "a3", "a4", "a5", "a6", "a7"}) in groups


def test_relatives_namesakes_and_roles_stay_apart(groups):
    for alone in ("b1", "b2", "c1", "c2", "e1", "e2", "n"):
        assert frozenset({alone}) in groups
    assert not any("d1" in g or "d2" in g for g in groups)


def test_short_names_and_initials(groups):
    assert frozenset({"f1", "f2", "f3"}) in groups and frozenset({"g1", "g2"}) in groups


def test_short_family_names_match_exactly(spark):
    people = [
        ("a1", "fox1", "Wei Li", "wei.li@corp.example"), ("a2", "fox2", "Wei Li", "wei.li@home.test"), ("a3", "fox3", "Wei Li", None), ("a4", "fox4", "Li, Wei", "misty.owl@other.test"),
        ("b1", "owl1", "Linda Roy", "linda.roy@corp.example"), ("b2", "owl2", "Linda Roy", "royl@home.test"), ("b3", "linda-roy", None, None), ("b4", "owl4", "Linda Royo", None), ("h1", "owl5", "Linda Zelkova", None),
        ("c1", "elk1", "Bo Wu", "bo.wu@corp.example"), ("c2", "elk2", "Bo Wu", "bo-wu@home.test"), ("d1", "elk3", "Greta Kim", None), ("d2", "elk4", "Greta Kim", None), ("e1", "elk5", "Greta Kimm", None),
        ("f1", "bat1", "Ute Ng", "ung@corp.example"), ("f2", "bat2", "Ute Ng", "ung2@corp.example"), ("g1", "bat3", "Ada Lee", "sleek@corp.example"), ("g2", "bat4", "Eva Lee", "sleek@home.test"),
    ]
    out = {}
    for r in identities.linked(spark.createDataFrame(people, "id string, github_login string, name string, email string")).collect():
        out.setdefault(r.person, set()).add(r.id)
    assert sorted(sorted(v) for v in out.values()) == [["a1", "a2", "a3", "a4"], ["b1", "b2", "b3"], ["b4"], ["c1", "c2"], ["d1", "d2"], ["e1"], ["f1"], ["f2"], ["g1"], ["g2"], ["h1"]]


def test_pairs_and_empty(spark):
    links = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", "a"), ("x", "x")], "id string, person string")
    assert sorted(map(tuple, identities.pairs(links).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert identities.linked(spark.createDataFrame([], "id string, github_login string, name string, email string")).count() == 0


@pytest.mark.parametrize("name, login, words", [("Doe, Jane M.", "x", ("jane", "doe")), ("DOE Jane", "x", ("jane", "doe")), ("JaneDoe", "x", ("jane", "doe")), ("Jane Doe-Roe, PhD", "x", ("jane", "doe")), ("jdoe", "jdoe", ("", "")), ("Unknown", "x", ("", "")), (None, "x", ("", ""))])
def test_tokens(name, login, words):
    assert identities.tokens(name, login) == words


@pytest.mark.parametrize("email, parts", [("<A.B+c@mail.X.example> ", ("a.b", "x.example")), ("1+a@users.noreply.forge.example", ("", "")), ("a at b.example", ("a", "b.example")), ("", ("", "")), (None, ("", "")), ("nothing", ("", ""))])
def test_address(email, parts):
    assert identities.address(email) == parts
