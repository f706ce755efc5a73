"""The pipeline against plain Python over a small corpus, and the queries' own contracts."""

import hashlib
import random

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_decontaminate import brute_contains
from tokenizers import Tokenizer

from fastenlake.llm.decontaminate import COVERAGE
from fastenlake.llm.queries import ORACLE_SQL, QUERIES
from fastenlake.llm.simhash import fingerprint

LETTERS = {"en": "the and ing tion er with of to house water", "fr": "le la eau oui tion ment dans avec sur pour", "de": "der die das ung heit und mit auf ist nicht"}
BENCH = ["what is the sum of three apples and nine pears in the red basket on the old table", "name the river that flows past the white castle near the green hill in spring"]


def make_tables(folder, empty=False):
    r = random.Random(9)
    prose = lambda lang, n: " ".join(r.choice(LETTERS[lang].split()) + r.choice(["a", "o", "en", "s", ""]) for _ in range(n))
    docs = []
    for i in range(160):
        lang = r.choice([*LETTERS])
        docs.append([i, "\n".join(prose(lang, r.randrange(20, 60)) for _ in range(r.randrange(1, 5))), lang, f"src{i % 14}", 0])
    for i in range(12):
        docs[i][1] += "\nAll rights reserved by the house of water"
    docs[20][1] += " " + BENCH[0] + " fin"
    docs[21][1] += ". " + BENCH[1].upper()
    docs += [[200, docs[30][1], docs[30][2], "src1", 0], [201, docs[30][1] + " ", docs[30][2], "src2", 0], [202, docs[31][1].replace(" the ", " the  "), "en", "src3", 0]]
    docs += [[300, None, None, None, None], [301, "", "en", "src0", 0], [302, "12 34 !!", None, "src5", 0], [303, prose("en", 9000), "en", "src0", 0]]
    docs = [] if empty else docs
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table([pa.array([d[i] for d in docs], f.type) for i, f in enumerate(schema)], schema), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([*range(len(BENCH))], pa.int64()), "text": BENCH}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "quality": pa.array([d[0] % 2 for d in docs], pa.int32()), "toxic": pa.array([0] * len(docs), pa.int32())}), f"{folder}/labels.parquet")
    turns = [] if empty else [(c, t, ("user", "assistant")[t % 2], prose("en", 5)) for c in range(6) for t in range(4)]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    pq.write_table(pa.table([pa.array([x[i] for x in turns], k) for i, k in enumerate(kinds)], ["conv_id", "turn", "role", "text"]), f"{folder}/conversations.parquet")
    return docs


def brute(docs):
    """Texts that are left by the first four stages, by doc_id."""
    left = {d[0]: (d[1], d[3]) for d in docs if d[1] and any(c.isalpha() for c in d[1])}
    sites, first = {}, {}
    for i, (t, s) in sorted(left.items()):
        for p, line in enumerate(t.split("\n")):
            k = line.strip(" \t\r\x0b\x0c")
            if k:
                sites.setdefault(k, set()).add(s or "")
                first.setdefault(k, (i, p))
    gone = {k for k, v in sites.items() if len(v) >= 3}
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c") not in gone or first[x.strip(" \t\r\x0b\x0c")] == (i, p)) for i, (t, _) in left.items()}
    prints = {i: fingerprint(t.encode()) for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {i: t for i, t in left.items() if find(i) == i}
    return {i: t for i, t in left.items() if not any(brute_contains(t, b)[0] >= COVERAGE for b in BENCH)}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    return str(folder), make_tables(folder)


def test_pipeline_equals_plain_python(spark, tables):
    folder, docs = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    want = brute(docs)
    assert {r["doc_id"] for r in rows} == set(want)
    assert not {20, 21, 200, 201, 300, 301, 302} & set(want) and len(want) > 140
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes


def test_stages_keep_the_columns_of_documents(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_judge_rows_of_repeated_and_null_ids_apart(spark, tables):
    folder, docs = tables
    clean = [d for d in docs if d[0] in range(60, 68)]
    odd = [[i, d[1], d[2], f"new{k}", k] for k, (i, d) in enumerate(zip([5, 5, None, None, 7, 7, 9, None], clean, strict=True))]
    prose = [d[1] for d in docs if d[0] in (68, 69)]
    extra = [[5, f"{prose[0]}. {BENCH[0]} x", "en", "s", 100], [None, f"{prose[1]}. {BENCH[1]}", "en", "s", 101], [5, None, "en", "s", 102], [None, "", None, None, 103]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rest = [[1000 + d[0], d[1], d[2], d[3], 1000] for d in docs if d[1] and d[0] < 60 and d[0] not in (20, 21)]
    df = spark.createDataFrame(odd + extra + rest, schema)
    # the benchmark's words are in none of the made-up languages
    for (name, stage), gone in zip(corpus_pipeline.STAGES, ({100, 101, 102, 103}, set(), set(), {100, 101}), strict=False):
        got = stage(spark, df, folder)
        left = [r["n_chars"] for r in got.collect() if r["n_chars"] < 1000]
        want = {*range(8), 100, 101, 102, 103} - gone
        if name == "simhash_dedup":
            want -= {103}  # null and empty are one text; a null doc_id goes behind 5
        assert set(left) == want and len(left) == len(want), name


@pytest.mark.parametrize("name", [*QUERIES])
def test_queries_on_small_and_empty_tables(spark, tables, tmp_path, name):
    folder, docs = tables
    got = QUERIES[name](spark, folder)
    rows = got.collect()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        cursor = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(cursor.fetchall(), key=str)
    elif name != "op10_decontaminate" and name != "op2_chat_format":
        assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    make_tables(tmp_path, empty=True)
    assert {r["conv_id"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {-1} if name.startswith("op2_") else QUERIES[name](spark, str(tmp_path)).collect() == []


def test_conversation_of_marks(spark, tables):
    (row,) = [r for r in QUERIES["op2_chat_format"](spark, tables[0]).collect() if r["conv_id"] == -1]
    mark = "<|im_end|><|im_start|>assistant ok"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(mark))
    assert row["loss_sha256"] == hashlib.sha256(mark.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{mark}\nassistant\n{mark}\n".encode()).hexdigest()


def test_packing_query_uses_few_sequences(spark, tables):
    rows = QUERIES["op4_best_fit_packing"](spark, tables[0]).collect()
    total = sum(r["length"] for r in rows)
    used = {r["sequence_id"] for r in rows}
    assert len(used) <= np.ceil(total / 4096) + 1
