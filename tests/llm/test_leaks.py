import random
import unicodedata

from claimloom.functions.text import words
from claimloom.llm import leaks


def data(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(3, 30)))) for i in range(8)] + [(8, None), (9, "")]
    docs = []
    for d in range(60):
        ws = r.choices([*vocab, "other"], k=r.randint(0, 20))
        if r.random() < 0.6:
            it = r.choice(items[:8])[1].split()
            a = r.randint(0, len(it) - 1)
            ws[len(ws) // 2 : len(ws) // 2] = it[a : a + r.randint(4, 20)]
        docs.append((d, r.choice([" ", "\n+ ", ", ", "\t"]).join(w.upper() if r.random() < 0.2 else w for w in ws)))
    return items, docs + [(60, None), (61, ""), (0, docs[0][1])]


def brute(items, docs, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t or "")] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}


def test_brute_force_both_ways(spark):
    for seed in (1, 2):
        items, docs = data(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        for n in (6, 12):
            for most in (leaks.MAX_GRAMS, 0):
                got = [(r.doc_id, r.item_id) for r in leaks.leaked_items(d, b, n, most).collect()]
                assert len(got) == len(set(got)) and set(got) == brute(items, docs, n)


def test_spans_are_cut(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep ONE, two\n+three four five! Stay"), (2, "nothing here"), (3, None), (4, "Ｏｎｅ ｔｗｏ three four ünd")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_words) for r in leaks.without_leaks(docs, items, 4).collect()}
    assert got == {1: ("Keep ! Stay", 5), 4: (" ünd", 4)}
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_spans_are_the_words_of_the_whole_text():
    r = random.Random(4)
    odd = [*"aeiouAkß½ﬁＡ .-1", *map(chr, (0x301, 0x308, 0x323, 0x327, 0x345, 0x3099, 0xFF76, 0xFF9E, 0x1112, 0x1161, 0x11AB, 0xD558, 0x9C7, 0x9BE, 0x344, 0x130, 0x1E9E, 0xC5, 0x2126))]
    for _ in range(3000):
        text = "".join(r.choices(odd, k=r.randint(0, 12)))
        spans = leaks._spans(text)
        assert [w for w, _, _ in spans] == words(text)
        assert all(words(text[a:b]) and w in words(text[a:b]) for w, a, b in spans)


def test_decomposed_leaks_are_cut(spark):
    item = "café über résumé naïve señor façade jalapeño crème brûlée élan"
    split = lambda t: unicodedata.normalize("NFD", t)
    items = spark.createDataFrame([(1, item), (2, "한국 사람 말씀 하나 둘")], "item_id long, text string")
    rows = [(1, "Keep " + split(item) + " stay"), (2, split("é ") + item + " é"), (3, split("앞 한국 사람 말씀 하나 둘 뒤")), (4, split("café über")), (5, "x " + split(item.upper()) + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, items, 4).collect()}
    assert found == {(1, 1), (2, 1), (3, 2), (5, 1)}
    got = leaks.without_leaks(docs, items, 4)
    assert {r.doc_id: (r.text, r.removed_words) for r in got.collect()} == {1: ("Keep  stay", 10), 2: (split("é ") + " é", 10), 3: (split("앞  뒤"), 5), 5: ("x !", 10)}
    assert leaks.leaked_items(got, items, 4).count() == 0


def test_spans_are_cut_alike_beyond_the_bound(spark):
    for seed in (3, 4):
        items, docs = data(seed)
        d, b = spark.createDataFrame([*docs, (None, docs[1][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        near, far = ([tuple(r) for r in leaks.without_leaks(d, b, 6, most).collect()] for most in (leaks.MAX_GRAMS, 0))
        assert sorted(map(repr, near)) == sorted(map(repr, far)) and len(near) > 5


def test_every_item_counts_however_many_are_blank(spark):
    text = "one two three four five six"
    items = spark.createDataFrame([(i, "") for i in range(60)] + [(60, None), (99, text)], "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(1, "Keep " + text + " stay")], "doc_id long, text string")
    for most in (5, 1):  # 40 and 8 characters
        assert [tuple(r) for r in leaks.leaked_items(docs, items, 4, most).collect()] == [(1, 99)]
        assert [tuple(r) for r in leaks.without_leaks(docs, items, 4, most).collect()] == [(1, "Keep  stay", 6)]
