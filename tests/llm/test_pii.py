import numpy as np
import pytest

from scanloom.llm import pii, pii_training


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.model())


def found(tagger, text):
    return [(k, text[a:b]) for k, a, b in pii.find(tagger, [text])[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("My colleague Kwame Nkrumah-Boateng wrote the runbook.", [("person_name", "Kwame Nkrumah-Boateng")]),
        ("Talk to Ana Lima and Priya Raghunathan about the outage; Ana Lima agreed.", [("person_name", "Ana Lima"), ("person_name", "Priya Raghunathan"), ("person_name", "Ana Lima")]),
        ("I spoke with Rebecca Thompson about this bug.", [("person_name", "Rebecca Thompson")]),
        ("Yours sincerely, Olivia Martin", [("person_name", "Olivia Martin")]),
        ("Our office moved to 12 Gresham Street last week.", [("street_address", "12 Gresham Street")]),
        ("Sent to us by J. Wu on Monday.", [("person_name", "J. Wu")]),
        ("Mail d.evans@norlith.test or dana [at] velmond [dot] test.", [("email", "d.evans@norlith.test"), ("email", "dana [at] velmond [dot] test")]),
        ("Call me at (202) 555-0116.", [("phone", "(202) 555-0116")]),
        ("Encontramos o CPF 308.156.907-46 no log.", [("id_number", "308.156.907-46")]),
        ("clone git@code.velmond.example:maple/folder.git first.", []),
        ("pinned maremond@4.2.34 and ondadegane@6.22.13.", []),
        ("The service Copper Harbor rejects members longer than 7983 bytes.", []),
        ("order 100-200-3000 of shard 62", []),
        ("Nada mudou desde a versão 4.2 do pacote.", []),
    ],
)
def test_sentences(tagger, text, want):
    assert found(tagger, text) == want


NAMES = {"name": "person_name", "address": "street_address", "email": "email", "phone": "phone", "id": "id_number"}


def score(tagger, docs):
    hit = miss = extra = 0
    for text, spans in docs:
        want = {(NAMES[k], a) for a, _, k in spans}
        got = {(k, a) for k, a, _ in pii.find(tagger, [text])[0]}
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    return hit / (hit + miss), hit / (hit + extra)


def test_held_out_sentences_and_names(tagger):
    """Sentences and listed names that neither the chain nor the skip edges' weight was fitted on."""
    recall, precision = score(tagger, pii_training.Maker(4242, held=True).documents(2000))
    assert recall > 0.88 and precision > 0.93


def test_held_out_parts_share_nothing():
    a, b = pii_training.Maker(1), pii_training.Maker(1, held=True)
    for x, y in ((a.given, b.given), (a.family, b.family), (a.positive, b.positive), (a.negative, b.negative)):
        assert not set(x) & set(y)


def test_skip_edges_help_on_held_out_documents(tagger):
    """The fitted weight makes fewer errors than none on documents whose persons return, and changes what is found."""
    docs = pii_training.Maker(77, held=True).documents(2500)
    assert tagger.skip > 0 and pii.errors(tagger.model, docs, tagger.skip) < pii.errors(tagger.model, docs, 0.0)


def test_chain_sums_against_enumeration():
    rng = np.random.default_rng(1)
    node, trans = rng.normal(size=(1, 4, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS),) * 2) + pii._allowed()
    mask = np.ones((1, 4), bool)
    f, b, _ = pii.chain_sums(node, mask, trans)
    p = f * b
    p /= p.sum(2, keepdims=True)
    k, total = len(pii.LABELS), np.zeros((4, len(pii.LABELS)))
    best = (-np.inf, None)
    for code in range(k**4):
        y = [(code // k**i) % k for i in range(4)]
        s = pii._START[y[0]] + sum(node[0, i, y[i]] for i in range(4)) + sum(trans[y[i], y[i + 1]] for i in range(3))
        best = max(best, (s, y))
        for i in range(4):
            total[i, y[i]] += np.exp(s)
    assert np.allclose(p[0], total / total[0].sum(), atol=1e-6)
    assert pii.chain_best(node, mask, trans)[0].tolist() == best[1]


def test_redaction_and_frames(spark, tagger):
    text = "Call Rebecca Thompson at +1 (202) 555-0155."
    assert pii.redact(text, pii.find(tagger, [text])[0]) == "Call [PERSON_NAME] at [PHONE]."
    long = "The nightly run of the parser took 56 minutes.\n" * 3000 + "# maintainer: Helen Okafor <h.okafor@tamarix.test>"
    rows = [(1, "Signed-off-by: Daniel Moreira <a.b@velmond.test>"), (2, None), (3, ""), (4, " \n "), (5, long), (6, "\x00퟿ ＡＢＣ ǅ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start_pos")
    got = {(r["doc_id"], r["pii_type"], r["start_pos"]) for r in pii.personal_data(df).collect()}
    at = len(long) - len("Helen Okafor <h.okafor@tamarix.test>") + 1
    assert got == {(1, "person_name", 16), (1, "email", 32), (5, "person_name", at), (5, "email", at + 14)}
    assert pii.personal_data(df.limit(0)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[1] == "Signed-off-by: [PERSON_NAME] <[EMAIL]>" and clean[2] is None and clean[3] == ""


def test_model_is_reproducible():
    a, b = pii.train(600, epochs=2), pii.train(600, epochs=2)
    assert a.index == b.index and np.array_equal(a.weights, b.weights)


def test_skip_links_take_any_case_and_short_names():
    words = ["Ana", "Vélden", "wrote", "to", "velden", "ana", "and", "A", "a", "wrote", "ANA", "Ana"]
    types = pii.Types(None)
    here, there = types.skip_links(types.ids(words), np.r_[np.zeros(11, int), 1])
    assert sorted(zip(here.tolist(), there.tolist(), strict=True)) == [(0, 5), (1, 4), (5, 10)]
