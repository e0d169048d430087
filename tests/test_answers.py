"""Answers in texts with accents, odd white space and odd line ends, against the same result in SQL."""

import duckdb
from quarry.plans import registry

TEXTS = [
    "Doíja. Elesrrueque", "éis", "á do it", "¿what", "ſure", "oK", "yes\x0b", "\x0byes", "yes\n", "yes\n\n", "yes\r\n", "yes\x85", "no ", " no", "ack ", "ack.\t!",
    "dtcs\rare saved", "dtcs are saved", "dtcs\nare saved", "dtcſ saved", "dtcs ásavedé", "what now ", "what next ", "what nowé?", "idlé", "üidle", "İs it", "ıdle", "key-onè", "Key off", "én/a", "bluiſh", "", None,
]


def test_answers_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'user', ?)", [(i, t, text) for i, text in enumerate(TEXTS) for t in range(8)])
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    df = registry.QUERIES["answer_classes"](spark, str(tmp_path))
    other = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL['answer_classes']}) ORDER BY 1, 2").fetchall()
    own = [tuple(r) for r in df.orderBy("conv_id", "turn").collect()]
    assert [(a, b) for a, b in zip(own, other) if a != b] == [] and len(own) == len(other) == 8 * len(TEXTS)
