import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words):
    return " ".join("".join(rng.choice(("an", "ber", "chi", "dor", "el", "fu")) for _ in range(rng.randint(1, 3))) for _ in range(words))


def odd_texts():
    """Nulls, blanks, ties, repeated rows, near copies, very long and periodic texts, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(rng, 90)
    return [
        None, "", " \t\r\n", base, base, f" {base}\n", base.upper(), near, near.replace("changed", "other"), "one two", "One  two", "one",
        passage + " " + prose(rng, 30), prose(rng, 30) + " " + passage, "a" * 3000, "ab" * 700, "Was. " * 300, prose(rng, 9000), "é日𝒳\x00\x1c  x", "▁ x  y \n\n z ",
        "password = hunter2hunter2 token: 'abc' AKIA" + "Z9" * 8 + " " + "0af3" * 10, "secret: token:abcdefghij", "Released under the MIT License. mit license, MIT-LICENSE",
    ]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folders with tables: odd (all odd texts, null and repeated ids, clashing columns), and empty."""
    from pyspark.sql import functions as F

    out = {}
    texts = odd_texts()
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None), (None, "only here " * 50, "de", "s9", 1), rows[7], rows[7]]
    item = texts[12].split()
    labels = [(k, k % 2, (k + 1) % 2) for k in range(20)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    items = [(0, " ".join(item[:40])), (1, None), (2, ""), (3, "three short words"), (0, "again the same id but other words in here now")]
    for name, docs, marks, bench in (("odd", rows, labels, items), ("empty", [], [], [])):
        folder = tmp_path_factory.mktemp(name)
        frame = spark.createDataFrame(docs, COLUMNS)
        if name == "odd":
            for c in ("row", "score", "node", "digest", "folium_row", "Item_ID", "h"):
                frame = frame.withColumn(c, F.lit("x"))
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out[name] = str(folder)
    return out
