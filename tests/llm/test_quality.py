"""The quality classifier against a plain version that holds all rows in memory."""

import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import xxhash

from inkwright.llm import quality, queries

SF = "/root/testdata/sf0.001"


def plain_text_features(text):
    """Counted byte by byte."""
    data = text.encode()
    kind = [1 if b in b"\t\n\x0b\x0c\r " else 2 if chr(b) in "0123456789" else 3 if 97 <= b <= 122 else 4 if 65 <= b <= 90 else 5 if chr(b) in ".,;:'\"()-" else 7 if b > 127 else 6 if 33 <= b <= 126 else 0 for b in data]
    out = np.zeros(512 + 8 + 6)
    for a, b, c in zip(kind, kind[1:], kind[2:]):
        out[64 * a + 8 * b + c] += 1 / max(1, len(data) - 2)
    for a in kind:
        out[512 + a] += 1 / len(data)
    out = np.sqrt(out)
    words, lines = data.lower().split(), data.split(b"\n")
    if words:
        n = len(words)
        out[520:] = len(set(words)) / n, np.log1p(n) / 10, sum(words[i] == words[i + 1] for i in range(n - 1)) / n, np.sqrt(len(set(lines)) / len(lines)), len(data) / n / 20, np.log1p(n / len(lines)) / 5
    return out


def test_text_features_are_what_they_say():
    for text in ("Ab c1, x", "one\ntwo\ntwo\n", "é ü 漢 #!? \x07", "a a a b", "x"):
        assert np.allclose(quality.text_features(text), plain_text_features(text))


def test_query_against_plain_co_training(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    labels = {r["doc_id"]: float(r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] is not None}
    xt = np.array([plain_text_features(d["text"]) for d in docs])
    xm = np.array([quality.meta_features(d["lang"], d["source"], d["n_chars"]) for d in docs])
    keys = np.array([xxhash.xxh64_intdigest(d["text"].encode(), 5) >> 1 for d in docs])
    mine = sorted((i for i, d in enumerate(docs) if d["doc_id"] in labels), key=lambda i: docs[i]["doc_id"])
    mine = sorted(mine, key=lambda i: -labels[docs[i]["doc_id"]])
    rest = [i for i in range(len(docs)) if i not in set(mine)]

    def surest(text, meta, counts):
        for view, model, x in (("text", text, xt), ("meta", meta, xm)):
            p = 1 / (1 + np.exp(-np.clip(model.logit(x), -35, 35)))
            for c, sure in ((0, 1 - p), (1, p)):
                best = {}
                for i in rest:
                    if sure[i] >= quality.SURE and (keys[i] not in best or sure[i] > sure[best[keys[i]]]):
                        best[keys[i]] = i
                for i in sorted(best.values(), key=lambda i: (-sure[i], keys[i]))[: counts[c]]:
                    yield view, c, keys[i], xt[i], xm[i]

    model = quality.co_train(xt[mine], xm[mine], np.array([labels[docs[i]["doc_id"]] for i in mine]), surest)
    want = dict(zip([d["doc_id"] for d in docs], zip(*model.score(xt, xm))))
    got = queries.op9_quality(spark, SF).collect()
    assert len(got) == len(docs)
    for x in got:
        q, t, m = want[x.doc_id]
        assert np.allclose([x.quality, x.by_text, x.by_metadata], [q, t, m], atol=1e-6), x.doc_id
        assert x.keep == (x.quality >= 0.5)


def test_repeated_keys_and_copies_do_not_reach_the_driver(spark, monkeypatch):
    rows = [(i, f"good words number {i} stand here in order" if i % 3 else f"### {i} $$$ %%% {i}", None, None, None) for i in range(60)]
    rows += [(1, "one key again", None, None, None)] * 500 + [(None, rows[1][1], None, None, None)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda xt, xm, y, surest, rounds: seen.append((len(y), xt.shape, surest)))
    assert quality.fit(df, labels) is None and seen[0][0] == 40


def test_the_driver_holds_the_features_of_labelled_rows_once(spark):
    """On the driver, a fit holds the labelled rows, the part that a view learns, and its scaled rows."""
    n = 6000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('plain words of row ', id, if(id % 3 = 0, ' ### $$$', ' in order')) AS text", "'en' AS lang", "concat('s', id % 9) AS source", "id AS n_chars")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 3 > 0) AS quality")
    quality.fit(df, labels, rounds=0)  # what is imported and kept is not counted
    tracemalloc.start()
    try:
        model = quality.fit(df, labels, rounds=0)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model is not None
    assert held < 4 * quality.LABELLED * 8 * (quality.N_TEXT + quality.N_META)
