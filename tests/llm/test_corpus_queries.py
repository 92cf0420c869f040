"""The registered queries themselves, over whole small tables: against their SQL, or by brute force."""

import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT / "tools"))
import __spark_entry__ as entry  # noqa: E402
from compare import rows  # noqa: E402
from guardloom.llm import html_text, packing, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
FOUND = queries.queries()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def documents(tables):
    return tables.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_all_eleven_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in FOUND)
    assert numbers == list(range(1, 11)) and set(FOUND) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, tables, name):
    ours = FOUND[name](spark, SF)
    cursor = tables.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(ours.columns) and rows(ours.columns, ours.collect()) == rows(names, cursor.fetchall())


def test_op2_rows_come_near_their_targets(spark):
    by_source = {}
    for r in FOUND["op2_mix"](spark, SF).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) < 1 for (_, target), taken in by_source.items())


def test_op4_pieces(spark, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    found, ends = {}, {}
    for r in FOUND["op4_pack"](spark, SF).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts = documents(tables)
    assert set(found) == {i for i, _ in texts}
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for start, length, crc, tokens in sorted(found[i]):
            assert (start, tokens, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    for parts in ends.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= 4096 and total & (total - 1) == 0
    assert sum(map(len, found.values())) < 2 * len(found)


def test_op5_counts(spark, tables):
    from guardloom.llm import counting

    pre = counting.PreTokens(counting.default_ranks(), counting.default_pattern())
    edited = {r["doc_id"]: r for r in FOUND["op5_tokens"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in whole_texts(spark)}
    assert set(edited) == {i for i, _ in documents(tables)}
    for i, r in edited.items():
        assert r["n_tokens"] == len(pre.coder.encode_ordinary(texts[i]))


def whole_texts(spark):
    """The texts that op5 counts, by plain string functions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.selectExpr("doc_id", "text", "pmod(xxhash64(doc_id, 1), length(text) + 1) AS a", "pmod(xxhash64(doc_id, 2), length(text) + 1) AS b")
    out = []
    for r in first.collect():
        text = r["text"][: r["a"]] + " inserted, it's new" + r["text"][r["a"] :]
        out.append({"doc_id": r["doc_id"], "text": text[: r["b"]] + "re " + text[r["b"] + 9 :]})
    return out


def test_op6_columns(spark, tables):
    got = FOUND["op6_toxicity"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in documents(tables)]
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_op7_fingerprints_and_classes(spark, tables):
    texts, fps = documents(tables), {}
    for i, text in texts:
        words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        grams = [b" ".join(words[n : n + 4]) for n in range(len(words) - 3)] if len(words) > 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if j < i and bin(fps[i] ^ fps[j]).count("1") <= 4:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in FOUND["op7_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", top(i)) for i in fps}


def test_op8_recall(spark, tables):
    vectors = {i: np.array(v, dtype=np.float64) for i, v in tables.execute("SELECT vec_id, embedding FROM embeddings").fetchall() if v is not None}
    found = {}
    for r in FOUND["op8_ann"](spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, got in found.items():
        scores = {i: float(v @ vectors[q]) for i, v in vectors.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert all(s == pytest.approx(scores[i], rel=1e-12) for _, i, s in got)
        hits, total = hits + len({i for _, i, _ in got} & set(best)), total + len(best)
    assert set(found) == {i for i in vectors if i % 20 == 0} and hits >= 0.9 * total


def test_op9_agrees_with_labels_it_has_not_seen(spark, tables):
    labels = dict(tables.execute("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    got = {r["doc_id"]: r for r in FOUND["op9_quality"](spark, SF).collect()}
    assert set(got) == {i for i, _ in documents(tables)}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2 and i in got]
    assert sum(got[i]["keep"] == (labels[i] == 1) for i in held) >= 0.9 * len(held)


def test_op10_rows(spark, tables):
    pages = dict(tables.execute("SELECT page_id, html FROM pages").fetchall())
    got = {r["page_id"]: r for r in FOUND["op10_html"](spark, SF).collect()}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r["text"] == html_text.main_text(pages[i]) and r["n_chars"] == len(r["text"])
        assert "&copy;" not in r["text"] and "<" not in r["text"].replace("<|", "")
