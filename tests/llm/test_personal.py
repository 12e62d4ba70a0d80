import pytest

from lithograph.llm import personal

NAMES = ["Anna", "Boris", "Clara", "David", "Emil", "Frida", "Georg", "Hanna"]
FAMILIES = ["Zelkova", "Marunten", "Polister", "Vandorf", "Kestrin", "Ulmenik"]


def corpus():
    rows = []
    for i in range(240):
        given, family = NAMES[i % 8], FAMILIES[i % 6]
        rows += [
            f"Fix the parser\n\nReported-by: {given} {family} <{given.lower()}.{family.lower()}+ci@mail{i % 3}.example>\n",
            f"Call +49 30 23125 {i:03d} if the job hangs. Reviewer {family}, {given} wants a test.",
            f"Removed SSN 9{i % 90 + 10:02d}-27-1{i:03d} from the fixture; see the Blue Harbor notes and the harbor branch in blue.",
            f"Ship it to Flat {i % 30 + 1}, {i + 1} Mill Lane, Oststadt. Version 4.{i}.12 of build 20240318.{i} is on 192.0.2.{i}.",
            f"cc {given.lower()} [at] corp [dot] test. Clone git@forge.example:core/api.git and wait {i} minutes.",
        ]
    return rows


@pytest.fixture(scope="module")
def model(spark):
    texts = spark.createDataFrame([(t,) for t in [*corpus(), None, ""]], "text string")
    return personal.fit(texts, "text", personal.gazetteers(texts, "text"))


@pytest.mark.parametrize("text, found", [
    ("Ping Clara Zelkova <clara.z@a.example>.", [("name", "Clara Zelkova"), ("email", "clara.z@a.example")]),
    ("cc x.y+z (at) mail.example", [("email", "x.y+z (at) mail.example")]),
    ("git@forge.example:core/api.git", []), ("image@sha256:9f", []), ("v4.12.7 on 10.4.2.1, order 2024-12-3456", []),
    ("Call (415) 555-0107 or 0044 (0)20 7946 0739.", [("phone", "(415) 555-0107"), ("phone", "0044 (0)20 7946 0739")]),
    ("Row 14 shows ssn: 931-37-5867 for E. Marunten.", [("id_number", "931-37-5867"), ("name", "E. Marunten")]),
    ("Ship the box to 64 East Bramble Ave, Apt 18, Tarnwick, OH 00087.", [("address", "64 East Bramble Ave, Apt 18, Tarnwick, OH 00087")]),
    ("It went to Gerberstr. 220a, 00003 Valmorin and 105 rue des Tilleuls, 00074 Hollow.", [("address", "Gerberstr. 220a, 00003 Valmorin"), ("address", "105 rue des Tilleuls, 00074 Hollow")]),
    ("Reviewer Vandorf, Emil wants a test first.", [("name", "Vandorf, Emil")]), ("see Blue Harbor notes", []), ("", []),
])
def test_decisions(model, text, found):
    assert [(k, text[a:b]) for k, a, b in personal.decide(text, model)] == found


def test_redaction_keeps_the_rest(spark, model):
    long = "plain words here. " * 20_000 + "Call +49 30 23125 123 if the job hangs."
    rows = [("a", "Call +49 30 23125 123 if the job hangs.\r\n  x", "c"), ("b", None, "c"), ("c", "", "c"), ("d", long, "c"), ("a", "Call +49 30 23125 123 if the job hangs.\r\n  x", "c")]
    out = personal.redacted(spark.createDataFrame(rows, "id string, text string, spans string"), "text", model)
    assert out.columns == ["id", "text", "spans", "clean_text"]
    by = {r.id: r for r in out.collect()}
    assert by["a"].clean_text == "Call [PHONE] if the job hangs.\r\n  x" and by["b"].clean_text is None and by["c"].clean_text == "" and by["d"].clean_text.endswith("Call [PHONE] if the job hangs.")
    assert out.count() == 5 and by["a"].spans[0].found_text == "+49 30 23125 123" and by["b"].spans == []


def test_empty_corpus(spark):
    texts = spark.createDataFrame([], "text string")
    model = personal.fit(texts, "text", personal.gazetteers(texts, "text"))
    assert personal.decide("Call +49 30 23125 123", model) == []


def test_estimates_follow_the_reliable_labeler():
    p = personal.estimate({("name", "++00+0"): 900, ("name", "-000-0"): 300, ("name", "+000-0"): 50, ("name", "-00000"): 10})
    assert p[("name", "++00+0")] > 0.9 > 0.2 > p[("name", "-000-0")]


# Sentences written apart from the test tables and from the corpus above.
OTHERS = [
    ("Call me on 98765 43210 after lunch.",[("phone","98765 43210")]),
    ("The form says CPF 123.456.789-09 and must not be stored.",[("id_number","123.456.789-09")]),
    ("Deliver to ul. Długa 5, 00-238 Warszawa please.",[("address","ul. Długa 5, 00-238 Warszawa")]),
    ("This was first noticed by 王小明 yesterday.",[("name","王小明")]),
    ("I spoke with Olumide Adeyemi about the rollout.",[("name","Olumide Adeyemi")]),
    ("Rahul Deshpande said the index is too slow.",[("name","Rahul Deshpande")]),
    ("Chinedu Okafor will look at it on Monday.",[("name","Chinedu Okafor")]),
    ("Write to billing.desk@northwind.example or to old_box@southwind.test.",[("email","billing.desk@northwind.example"),("email","old_box@southwind.test")]),
    ("My number is +44 7911 123456, ring before noon.",[("phone","+44 7911 123456")]),
    ("Phone: (212) 555-0188",[("phone","(212) 555-0188")]),
    ("Her social security number is 078-05-1120.",[("id_number","078-05-1120")]),
    ("They moved to 221 Baker Street, London NW1 6XE last year.",[("address","221 Baker Street, London NW1 6XE")]),
    ("The parcel for 12 rue de la Paix, 75002 Paris came back.",[("address","12 rue de la Paix, 75002 Paris")]),
    ("Besuch bitte in der Lindenstraße 14, 10969 Berlin melden.",[("address","Lindenstraße 14, 10969 Berlin")]),
    ("ask jane dot doe at example dot org",[("email","jane dot doe at example dot org")]),
    ("Thanks to Ingrid Bergqvist for the patch.",[("name","Ingrid Bergqvist")]),
    ("cc: T. Nakamura, please review.",[("name","T. Nakamura")]),
    ("Passport no. XK1234567 was in the log.",[("id_number","XK1234567")]),
    ("Reach support at help [at] vendor [dot] example.",[("email","help [at] vendor [dot] example")]),
    ("Send it to 4 Privet Drive, Little Whinging.",[("address","4 Privet Drive, Little Whinging")]),
    ("Upgrade to 10.4.2.1 failed on build 20240318.", []), ("Order 2024-12-3456 has 555 0123 rows", []), ("", []),
]


def test_sentences_of_other_origin(model):
    wanted = {(t, k, x) for t, found in OTHERS for k, x in found}
    got = {(t, k, t[a:b]) for t, _ in OTHERS for k, a, b in personal.decide(t, model)}
    assert len(wanted & got) >= 0.9 * len(wanted) and len(got - wanted) <= 2


def test_unknown_names_do_not_depend_on_the_size_of_the_gazetteer():
    few, many = (personal.Gazetteers(frozenset(f"Nam{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)), frozenset()) for n in (3, 600))
    text = "I spoke with Olumide Adeyemi about it."
    assert [personal.votes(text, ("name", 13, 28), g) for g in (few, many)] == [personal.votes(text, ("name", 13, 28), few)] * 2


def test_every_labeler_may_be_the_only_one_that_speaks_against():
    p = personal.estimate({("name", "+++0+0"): 900, ("name", "+00-0-"): 400, ("name", "+000-0"): 200})
    assert p[("name", "+++0+0")] > 0.9 > 0.1 > max(p[("name", "+00-0-")], p[("name", "+000-0")])
    only = personal.estimate({("email", "+++0+0"): 500, ("email", "+++000"): 100})
    assert min(only.values()) > 0.9
