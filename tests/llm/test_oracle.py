"""Queries with SQL, on the small tables and on tables made to hold copies, quotes and odd vectors."""

import random

import duckdb
import pandas as pd
import pytest

from quarry.llm import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "pages", "embeddings", "benchmark")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_small_tables(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    same(spark, con, FOLDER, name)


def same(spark, con, folder, name):
    rel = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(rel.columns)
    assert set(columns) <= set(df.columns)
    own = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert own == sorted(tuple(map(str, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("made"), random.Random(8)
    words = [f"W{i}" if i % 3 else f"w{i}" for i in range(90)]
    base = [rng.choices(words, k=rng.randint(3, 70)) for _ in range(25)]
    docs = []
    for d in range(160):
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((d, None if d == 3 else "" if d == 4 else " \n".join([" ".join(w[:9]), " ".join(w[9:])]), "en", "s", 1))
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(folder / "documents.parquet")
    items = [(i, rng.choice([" ", ", ", "_"]).join(rng.choices([*words, "nowhere"], k=rng.randint(1, 12)))) for i in range(20)] + [(20, None), (21, "-"), (3, "W1 w1")]
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    talk = []
    for c in range(30):
        said = []
        for t in range(8):
            lines = [" ".join(rng.choices(words[:12], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
            mark = rng.choice([">", ">", "|", ">|"]) * rng.randint(1, 2)
            quote = [f"{mark}{rng.choice(['', ' '])}{x}" for x in rng.choice(said)] if said and rng.random() < 0.6 else []
            if quote and rng.random() < 0.5:
                quote = [rng.choice(["On Monday W3 wrote:", "Am 3. Mai schrieb w4 :", "> Le soir, w1 a écrit:", "on time wrote nothing"]), *([""] if rng.random() < 0.5 else []), *quote]
            if rng.random() < 0.2:
                lines = ["| a | b |", *lines]
            talk.append((c, t, "user", None if rng.random() < 0.05 else "\n".join([*quote, *([""] if rng.random() < 0.3 else []), *lines])))
            said.append(lines)
    pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"]).to_parquet(folder / "conversations.parquet")
    pages = [(i, "u", rng.choice([None, "", "é", "<p>a</p>", f"<p>{i}</p>"])) for i in range(80)]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(folder / "pages.parquet")
    points = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [(i, [x + rng.choice([0, 0.01, 0.1]) * rng.gauss(0, 1) for x in rng.choice(points)], i % 2) for i in range(140)]
    pd.DataFrame(vectors, columns=["vec_id", "embedding", "label"]).to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_made_tables(spark, made, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{made}/{t}.parquet'")
    same(spark, con, made, name)
