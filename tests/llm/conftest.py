import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # extra columns whose names clash with results
        T.StructField("n_words", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
    ]
)


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioutrsnl") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["über", "été", "niño", "漢字", "😀"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = prose(30000)
    shared = prose(60)
    odd = [
        None,
        "",
        "   \n\t ",
        "one",
        "a b",
        "Password: 'abcdef' token=ab token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"; AKIA4ZZZ2345678QQ AKIA12 é secret:zzzzzzzzz==",
        "api_key='aaaaaaaa' APIKEY : bbbbbbbb password: token: abcdefgh1234 deadbeefdeadbeefdeadbeefdeadbeef0 x7Kp9QzR4mWvT2yB8nLcD6fH",
        "mail é: a.b+c@d-e.com, x@y x@y.z.w_q@r.st 1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 +1 (499) 555-6503. +12 3",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 12 34 +49 (0)30 1234567890 0000000000000000",
        "Licensed under CC BY-NC 4.0. cc by cc by. GNU General Public License. ALL RIGHTS RESERVED",
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. é all rights reserved",
        "<|startoftext|>Hi <|endoftext|>x É 'S don't 123 !!!!!?? K ΣΑΣ \x1c \xa0a İstanbul 　 漢字 ½ ªº ǅ",
        "#" * 500 + " $$$ a%%% " * 40,
        "la la la " * 300,
        "same line here\n" * 80,
        "WOW!! " * 100,
        "1" * 30000,
        "a" * 30000,
        "+1" + "(" * 20000,
        long,
        prose(500) + " " + shared + " " + prose(20),
        prose(30) + " " + shared + " " + prose(200),
        "x " * 40 + shared,
    ]
    copy = prose(120)
    near = copy.split()
    return odd + [copy] * 40 + [" ".join(near[:60] + [w] + near[61:]) for w in vocabulary[:10]] + [prose(rng.randint(1, 300)) for _ in range(120)]


@pytest.fixture(scope="session")
def rows():
    found = []
    for i, text in enumerate(texts()):
        found.append((i, text, "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 7}", len(text or ""), "x", "y", "z", "k", "f"))
    found += [found[5], (None, "no id 1.2.3.4", "en", "hot", 13, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table_dir(docs, empty, tmp_path_factory):
    """Folders with the fixture and with an empty table as ``documents``."""
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{top}/full/documents.parquet")
    empty.write.parquet(f"{top}/empty/documents.parquet")
    return str(top)
