"""Tables with the cases every operator must take: nulls, empty and very long texts, repeats, clashing column names."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, spans string, n_words long, "
          "component_id long, key long, cluster string, pos int, item_id long, bin_id string, start int, label int, predicted int")


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    syllables = "ba de ki lo mu na pe ri so tu ran len mis tor vek".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(2_000)]
    out = []
    for i in range(n):
        w = r.choice(words)
        out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(out)


def rows() -> list[tuple]:
    texts = [(1, prose(120, 1)), (2, prose(120, 1)), (3, None), (4, ""), (5, "  \n\t "), (6, "word"), (7, "two words"), (8, prose(30_000, 2)),
             (9, "a" * 100_000), (10, "x " * 5_000), (11, "12 " * 3_000 + "@" * 2_000), (None, prose(60, 3)), (None, None), (12, prose(200, 4)),
             (12, prose(200, 4)), (13, "é ß İ K     日本 " * 40), (14, "\n".join(["same line here"] * 50)), (15, "." * 20_000)]
    clash = (0.5, True, "x", 7, 3, 4, "c", 1, 2, "b", 0, 1, 1)
    return [(i, t, "en" if i != 6 else None, None if i == 7 else "hot", None if t is None else len(t), *clash) for i, t in texts]


def frame(spark, only_schema: bool = False):
    return spark.createDataFrame([] if only_schema else rows(), SCHEMA)


def labels(spark, only_schema: bool = False):
    data = [] if only_schema else [(1, 1, 0), (1, 1, 1), (2, 1, 0), (8, 1, 0), (10, 0, 1), (11, 0, 0), (14, 0, 1), (None, 1, 1), (12, None, None), (999, 1, 1)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def benchmark(spark, only_schema: bool = False):
    data = [] if only_schema else [(1, prose(200, 4)[:300]), (2, None), (3, ""), (4, "too short"), (None, prose(40, 9)), (1, prose(200, 4)[:300])]
    return spark.createDataFrame(data, "item_id long, text string")
