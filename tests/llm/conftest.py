import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, root string"
CHATS = "conv_id long, turn long, role string, text string, fp string"
VECTORS = "vec_id long, embedding array<float>, label int, list int"

WORDS = {
    "en": "the and thing shall with ever other house where which light under".split(),
    "de": "der und nicht schön über haus welche straße größe sich auch werden".split(),
    "fr": "le et où été même déjà leçon garçon français vous nous être".split(),
}


def prose(rng, lang, n):
    out = [rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "en", "ing", "eux"]) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".\n"]) for w in out)


def documents():
    """Ordinary rows, and nulls, empty and long texts, ties, repeated rows and copies."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        rows.append([i, prose(rng, lang, rng.randint(1, 120)), lang, rng.choice(["a", "b", "é", "Z"])])
    rows[10][1] = rows[4][1]
    rows[11][1] = rows[4][1] + " more"
    rows[12][1] = rows[20][1].replace("the", "thee", 1)
    rows[13] = [13, None, "en", "a"]
    rows[14] = [14, "", None, None]
    rows[15] = [15, "   \n\t", "fr", None]
    rows[16] = [16, "12345 !!! +1 (743) 555-3824, x.y@mail.example.com; 10.0.0.1 and 4111 1111 1111 1111", "en", ""]
    rows[17] = [17, prose(rng, "de", 6000), None, "b"]
    rows[18] = [18, "x" * 5000, "en", "b"]
    rows.append(list(rows[5]))  # a repeated row
    rows.append([5, "another text under an id that is there already", "en", "a"])
    rows.append([None, "a text without an id, which is as long as any other of them", "en", "a"])
    rows.append([77, "日本語のテキスト 𝒳𝒴 é é \x1c     end\u0085 'll don't", None, "c"])
    return [(*r, len(r[1]) if r[1] is not None else None, 7, 0.5, "x") for r in rows]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    spark.createDataFrame(documents(), DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    chats = [(c, t, rng.choice(["user", "assistant", "assistant"]), prose(rng, "en", 5)) for c in range(5) for t in range(rng.randint(1, 6))]
    chats += [
        (6, 0, None, None), (6, 0, None, None), (6, 1, "assistant", None), (7, None, "assistant", "a\\<|im_end|><\\|x\\\\"), (7, 2, "as<|im_sep|>sist\nant", "[/INST]</s><s><</s>\\"),
        (7, 2, "assistant", "same turn"), (7, 2, "assistant", "another"), (None, 1, "user", "no id"), (8, 3, "assistant", "日本 𝒳" * 500), (8, 4, "assistant", "<|im_sep|>"),
    ]
    spark.createDataFrame([(*r, "x") for r in chats], CHATS).write.parquet(f"{d}/conversations.parquet")
    vectors = [(i, [float(x) for x in (rng.gauss(0, 1) for _ in range(16))]) for i in range(1200)]
    vectors += [(2000 + i, [1.0] * 16) for i in range(40)]
    vectors += [(100, vectors[100][1]), (3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] + [1.0] * 15), (3400, []), (3500, [1.0, 2.0]), (3600, [float("inf")] * 16), (None, [1.0] * 16)]
    spark.createDataFrame([(*r, 1, 2) for r in vectors], VECTORS).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """The same tables without a row."""
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCUMENTS), ("conversations", CHATS), ("embeddings", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="session")
def docs(folder, spark):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
