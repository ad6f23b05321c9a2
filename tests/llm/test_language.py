import numpy as np
import pytest

from obsframe.llm import language as lg

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return lg.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = lg.languages_of(docs, spark.read.parquet(f"{FOLDER}/pages.parquet"))
    rows = out.where("doc_id is not null").join(docs.where(lg.held_out(docs["doc_id"])).select("doc_id", docs["lang"].alias("true")), "doc_id").collect()
    assert len(rows) > 2000 and sum(r.lang == r.true for r in rows) / len(rows) > 0.99
    assert out.where("page_id is not null").count() == 2500 and out.where("probability between 0 and 1").count() == 12500


def softmax(x):
    e = np.exp(x - np.max(x))
    return e / e.sum()


def test_against_plain_fusion(spark, model):
    """The whole of it in plain Python on a few pages."""
    languages, logs = model
    texts = ["the and of to was", "der die und ist", "", "les des et la", "the", "und", "los las que del", "x"]
    rows = []
    for i, text in enumerate(texts * 3):
        lang, url = ["en", "de", "zz", None][i % 4], [f"http://a{i % 2}.x.de/en/p", "https://b.y.de:80/q", "http://c.fr/de", None][i % 4 if i % 5 else 1]
        rows.append((i, url, None if i == 7 else f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><script>the</script><p>{text}</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    items = lg.page_items(pages).collect()
    evidence = lg.text_evidence([r.text for r in items], logs)
    chances = [softmax(e) for e in evidence]
    guess = [languages[int(np.argmax(c))] for c in chances]

    def declared(column, r):
        value = r[column]
        if not value:
            return np.zeros(len(languages))
        known = lambda v: v if v in languages else "other"
        pairs = [(known(o[column]), g) for o, g in zip(items, guess) if o[column]]
        return np.log([(pairs.count((known(value), g)) + 1) / (sum(p[1] == g for p in pairs) + len(languages) + 1) for g in languages])

    for i, r in enumerate(items):
        total = sum(chances)
        prior = (total + 1) / (total.sum() + len(languages))
        for keys in (["suffix"], ["suffix", "domain"], ["suffix", "domain", "host"]):
            rest = sum(c for o, c in zip(items, chances) if all(o[k] == r[k] for k in keys)) - chances[i]
            prior = (np.maximum(rest, 0) + lg.SMOOTHING * prior) / (np.maximum(rest, 0).sum() + lg.SMOOTHING)
        wanted = softmax(evidence[i] + np.log(prior) + declared("declared", r) + declared("hinted", r))
        found, = lg.identify(lg.page_items(pages), model).where(f"page_id = {r.page_id}").collect() if i in (0, 5, 7) else [None]
        if found is not None:
            assert found.lang == languages[int(np.argmax(wanted))] and found.probability == pytest.approx(wanted.max(), abs=1e-6)


def test_parts_of_pages(spark):
    pages = spark.createDataFrame([(1, "HTTP://user@A.B.Example.COM:80/fr/x", '<!-- a --><HTML class=x LANG=\'de-AT\'><style>s</style>t<b>u'),
                                   (2, None, None), (3, "nonsense", "<html>")], "page_id long, url string, html string")
    out = {r.page_id: r for r in lg.page_items(pages).collect()}
    assert out[1].text.split() == ["t", "u"] and out[1][2:] == ("de", "fr", "a.b.example.com", "example.com", "com")
    assert out[2][2:] == out[3][2:] == ("", "", "", "", "")


def test_odd_tables(spark, documents):
    pages = spark.createDataFrame([(1, None, None), (None, None, "<p>a"), (1, None, None)], "page_id long, url string, html string")
    docs = documents([(i, "the and of" if i % 2 else "") for i in range(20)] + [(None, None), (3, "word " * 100_000)])
    out = lg.languages_of(docs, pages).collect()
    assert len(out) == 25 and {r.lang for r in out} == {"en"}
    none = lg.languages_of(documents([]), pages).collect()
    assert len(none) == 3 and {r.lang for r in none} == {None}
    assert lg.languages_of(documents([]), pages.limit(0)).count() == 0
