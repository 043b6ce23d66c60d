"""SQL twins against their operators on tables with the cases that the driver tables lack."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from flowlab.llm import oracle, registry

DE, SPACED, GB, NO = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947"


def tables():
    texts = [f"{DE} Bank", f"to {SPACED} Please", f"{GB} 2024", f"{DE} {GB} X {NO}", f"é漢😀 {SPACED} BIC", f"AB12 CD34 EF56 {DE} OK", f"{DE}1", None, "",
             "A1" * 40, " ".join(f"AB{i % 90 + 10} CD{i % 83 + 10}" for i in range(900)), f"{DE}{DE} {DE},{DE}", "a@b.co 10.0.0.1 4111 1111 1111 1111 +49 30 123456"]
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    texts += [" ".join(words[:80]), "x " + " ".join(words[:90]), " ".join(words[30:]) + " \n"]
    docs = pd.DataFrame({"doc_id": pd.array([*range(len(texts) - 1), None], "Int64"), "text": texts, "source": (["a", None, "b"] * len(texts))[:len(texts)]})
    vectors = pd.DataFrame({"vec_id": pd.array([0, 0, 50, 1, 2, 3, None, 50, 100], "Int64"), "embedding": [rng.normal(size=4).tolist() for _ in range(9)]})
    pages = pd.DataFrame({
        "page_id": range(7), "url": ["http://a.org/x", "http://b.com/y", "http://c.com/z", "http://org/fr/1", "http://d.com", "http://e.com/", "bad"],
        "html": ['<a href="http://bad.net/q">x</a><a href="//worse.net/">', '<a href="http://org/fr/2">', '<a href="http://b.com/k"><a href=\'http://org/fr/\'>',
                 '<a href="http://e.com/">', None, '<a href="http://example.com/de/a"><a href="http://example.com/en/">', '<a href="http://x.net/">']})
    talks = pd.DataFrame([(c, t if t else None, "user" if t % 2 else None, f"turn {t * (c % 3)}") for c in [*range(20, 45), -20, -7] for t in range(c % 5 + 1)]
                         + [(None, 1, "user", "x"), (21, 0, None, None), (21, 0, None, None)], columns=["conv_id", "turn", "role", "text"])
    talks["conv_id"], talks["turn"] = talks["conv_id"].astype("Int64"), talks["turn"].astype("Int64")
    return {"documents": docs, "embeddings": vectors, "pages": pages, "conversations": talks}


def plain(rows):
    def one(v):
        return "null" if v is None or v != v else round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, (bool, np.integer)) else v
    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_twin_equals_operator(spark, tmp_path_factory, name):
    place = tmp_path_factory.mktemp("twins")
    with duckdb.connect() as con:
        for t, frame in tables().items():
            frame.to_parquet(f"{place}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{place}/{t}.parquet'")
        got = registry.QUERIES[name](spark, str(place))
        cols = sorted(got.columns)
        cursor = con.execute(oracle.ORACLE[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == cols
        want = plain(tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall())
    assert plain(tuple(r[c] for c in cols) for r in got.collect()) == want and want
