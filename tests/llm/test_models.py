import numpy as np
import pytest

from claimloom.llm import abuse, language

SENTENCES = {
    "id": "Warga di kampung itu melaporkan bahwa jembatan rusak setelah hujan deras semalam.",
    "en": "The mayor hopes that the bridge will be open again before the end of the week.",
    "de": "Die Anwohner berichten, dass die Brücke nach dem langen Regen beschädigt war.",
    "es": "Los vecinos dicen que el puente quedó dañado después de muchas horas de lluvia.",
    "fr": "Les habitants disent que le pont a été abîmé après plusieurs heures de pluie.",
    "pt": "Os moradores dizem que a ponte ficou danificada depois de muitas horas de chuva.",
}


def test_code_words_differ():
    for i, a in enumerate(language.CODE):
        for b in language.CODE[i + 1 :]:
            assert (a != b).sum() == 16


@pytest.mark.parametrize("lang", SENTENCES)
def test_one_language(lang):
    m = language.load_model()
    for text in (SENTENCES[lang], SENTENCES[lang].upper(), "  ... " + SENTENCES[lang] + "\n" + SENTENCES[lang]):
        (start, got, confidence, ambiguous), *more = language.segments(text, m)
        assert got == lang and not more and confidence > 0.9 and not ambiguous and text[start].isalnum()


def test_mixed():
    m = language.load_model()
    for a in SENTENCES:
        for b in SENTENCES:
            if a != b:
                text = f"{SENTENCES[a]}\n\n“{SENTENCES[b]}” {SENTENCES[a]}"
                at = text.index(SENTENCES[b])
                back = text.index(SENTENCES[a], at)
                assert [x[:2] for x in language.segments(text, m)] == [(0, a), (at, b), (back, a)]


def test_labels():
    assert [language.label_language(x) for x in ("id", "ID", "id_ID", "ind", "en-GB", "nl", "und", "", None, " n/a ")] == ["id", "id", "id", "id", "en", "nl", None, None, None, None]


def test_report(spark):
    rows = [(1, SENTENCES["id"], "IND"), (2, SENTENCES["id"], "en"), (3, SENTENCES["fr"], None), (4, None, "fr"), (5, " ", "fr"), (6, "123 ...", None), (7, "...", "en"), (1, SENTENCES["id"], "IND")]
    df = spark.createDataFrame(rows, "rec_id long, text string, language string")
    got = {(r.rec_id, r.seg_start, r.lang) for r in language.label_report(df).where("not label_ok").collect() if r.rec_id != 6}
    assert got == {(2, 0, "id"), (3, 0, "fr")}
    assert language.label_report(df.limit(0)).count() == 0


def test_training_holds_out():
    rows = [(s, lang) for lang, s in SENTENCES.items() for _ in range(5)] + [(SENTENCES["de"], "en")]
    m = language.train(rows, passes=2)
    assert language.segments("Die Anwohner berichten von Regen und der Brücke dort.", m)[0][1] == "de"


def test_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    net = abuse.Network.fresh()
    x = r.normal(size=(6, 5, 2 * abuse.EMBED)).astype(np.float32)
    mask = np.ones((6, 5, 1), np.float32)
    mask[3:, 1] = 0
    y, w = np.array([1, 0, 1, 0, 1], np.float32), np.ones(5, np.float32)
    g, _, _ = net.gradients(x, mask, y, w)
    for k in ("Uf", "Wb", "v", "w", "bf"):
        i = tuple(n // 2 for n in net.p[k].shape)
        net.p[k][i] += 1e-2
        up = net.gradients(x, mask, y, w)[2]
        net.p[k][i] -= 2e-2
        down = net.gradients(x, mask, y, w)[2]
        net.p[k][i] += 1e-2
        assert abs(g[k][i] - (up - down) / 2e-2) < 2e-4


def test_abuse_scores(spark):
    clean = "commit 1a2b3c\n\n    Fix the router when the cache is empty\n\n+    os.kill(child.pid, 9)\n+    sex = row.get('sex')\n"
    bad = clean + "+    # shut up you idiot, nobody wants your patches here\n" + clean * 20
    hidden = clean + "+    # Go kill yourself m-o-r-o-n, the project is better off without you\n"
    rows = [(1, clean), (2, bad), (3, hidden), (4, None), (5, ""), (6, "..."), (2, bad)]
    got = sorted((r.doc_id, r.score) for r in abuse.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    hit = [(i, s >= abuse.THRESHOLD) for i, s in got]
    assert hit == [(1, False), (2, True), (2, True), (3, True), (4, False), (5, False), (6, False)] and got[4][1] == 0


def test_all_windows_cover_all_words():
    for n in (0, 1, 23, 24, 25, 36, 100, 101):
        ws = abuse.windows(n)
        assert {i for a, b in ws for i in range(a, b)} == set(range(n)) and all(b - a <= abuse.WINDOW for a, b in ws)


def test_small_training_learns():
    rated = [(f"alpha beta gamma {i} delta you horrible {w} go away now epsilon", 1) for i, w in enumerate(["fool", "brute", "swine"] * 20)]
    rated += [(f"alpha beta gamma {i} delta please merge the {w} change today epsilon", 0) for i, w in enumerate(["nice", "small", "green"] * 60)]
    net = abuse.train(rated, passes=2, steps=60, batch=48)
    a, b = abuse.document_scores([net], ["zeta eta you horrible brute go away now", "zeta eta please merge the small change today"])
    assert a > 0.5 > b


def test_every_network_of_the_committee_counts():
    class Fixed:
        """Gives each word its own number; a window scores its first word's."""

        def __init__(self, told):
            self.told, self.seen = told, 0

        def inputs(self, tokens):
            return np.array([int(t[1:]) for t in tokens], np.int32)

        def scores(self, rows, length):
            self.seen += len(rows)
            return np.array([self.told[r[0]] for r in rows], np.float32)

    told = [(0.001, 1, 1, 1), (0.9, 0.9, 0.9, 0.9), (0.2, 0.7, 1, 1), (0.5, 0.5, 0.1, 0.2), (1, 1, 1, 0.12)]
    texts = [f"w{i} w0 w1" for i in range(5)] + [None, "", " ".join(["w3"] * 12 + ["w1"] * 24)]
    full = [float(np.prod(np.maximum(t, 1e-12))) ** 0.25 for t in told] + [0, 0, 0.9]
    nets = [Fixed([t[k] for t in told]) for k in range(4)]
    assert np.allclose(abuse.document_scores(nets, texts), full, atol=1e-6)
    nets = [Fixed([t[k] for t in told]) for k in range(4)]
    got = np.array(abuse.document_scores(nets, texts, 0.6))
    assert [x >= 0.6 for x in got] == [x >= 0.6 for x in full] and np.allclose(got[got >= 0.6], [x for x in full if x >= 0.6], atol=1e-6)
    assert nets[3].seen < nets[0].seen
