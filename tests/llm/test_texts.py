"""Chat formatting, packing, counting, HTML, toxicity and quality."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from guardloom.llm import chat, counting, html_text, packing, quality, toxicity, wordpiece
from pyspark.sql import functions as F

ODD = ["", " ", "Foo's É, ÷a !!'s  x", "Å. İ, ÉCOLE!! é'", "<|ENDOFTEXT|> a<|endoftext|>b, C!", "a b c", "tab\tnew\nline\x0bv\x0cf", "ΟΔΟΣ Σ", "日本語 mixed123text", "x" * 9000, "é É.", "\u001c\u0085 z", "don't STOP'RE we'll", "a|b <|x", "©®™ ½ ²"]


# chat
def chats(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "clash") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, chat string")


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "bye"), ("assistant", None)]
    rows = [(1, i, *t) for i, t in enumerate(a[:2])] + [(2, i, *t) for i, t in enumerate(a)] + [(3, i, *t) for i, t in enumerate(a)]
    rows += [(4, 0, "user", "hi"), (5, 0, "user", "other"), (6, 0, "user", "hi"), (6, 1, "assistant", "yo!"), (None, 0, "user", "lost")]
    rows += [(7, None, None, ""), (8, 0, "user", "x"), (8, 0, "user", "x"), (9, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(chats(spark, rows)).collect()}
    assert {k: (r["n_turns"], r["n_copies"]) for k, r in got.items()} == {2: (4, 2), 5: (1, 1), 6: (2, 1), 7: (1, 1), 8: (2, 1)}
    assert got[6]["chat"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo!<|end|>\n" and got[7]["chat"] == "<||>\n<|end|>\n"
    assert got[2]["chat"].endswith("<|assistant|>\n<|end|>\n")
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_a_null_is_not_an_empty_text(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", ""), (2, 1, "user", "x")]
    assert {r["conv_id"] for r in chat.format_chats(chats(spark, rows)).collect()} == {1, 2}


# packing
def test_ids_are_the_tokenizers_own():
    words = wordpiece.WordIds(packing.default_tokenizer())
    for group in (ODD, [x for x in ODD if "<|" not in x], [""]):
        ids, ends = wordpiece.encode(pa.array(group), words, 2)
        for text, part in zip(group, np.split(ids, ends[:-1])):
            assert part.tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(1)
    texts = [None, *ODD] + [" ".join(f"w{rng.random()}" for _ in range(rng.choice([1, 30, 700, 3000]))) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)], "doc_id long, text string, start int").repartition(3)
    rows = packing.pack(frame).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], set()).add((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for i, text in enumerate(texts):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        found = sorted(pieces[i])
        assert np.frombuffer(b"".join(p[1] for p in found), "<u4").tolist() == want
        assert [p[0] for p in found] == [sum(len(q[1]) // 4 for q in found[:n]) for n in range(len(found))]
        assert {p[2] for p in found} == {len(want)}
    assert len([r for r in rows if r["doc_id"] == 3]) == 2 * len(pieces[3])
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096 and end & (end - 1) == 0  # no padding at all
    assert packing.pack(frame.limit(0)).count() == 0


# counting
def test_edited_counts():
    pre = counting.PreTokens(counting.default_ranks(), counting.default_pattern())
    rng = random.Random(2)
    for base in [*ODD, "  ".join(f"word{i}'s" for i in range(2000))]:
        text, tree = base, counting.build(base, pre)
        for _ in range(25):
            new = rng.choice(["", " ", "a", "\n\n ", "'re", "some words " * rng.choice([1, 400])])
            text, tree, _ = counting.edit(text, tree, rng.randint(-3, len(text) + 3), rng.choice([0, 1, 7, 500]), new, pre)
            assert tree.total[0] == len(text)
            assert tree.total[1] == len(pre.coder.encode_ordinary(text))
            assert tree.total[2] == len(pre.pattern.findall(text))


def test_edits_touch_little(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    frame = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (None, "a b", "x")], "doc_id long, text string, n_tokens string")
    counted = counting.count_tokens(frame)
    edits = F.array(F.struct(F.lit(1000).alias("start"), F.lit(3).alias("length"), F.lit("new").alias("new")), F.lit(None))
    got = {r["doc_id"]: r for r in counting.apply_edits(counted, edits).collect()}
    assert got[1]["encoded_chars"] < 2000 and got[1]["text"] == text[:1000] + "new" + text[1003:]
    assert got[2]["text"] == "new" and got[2]["n_tokens"] == 1 and sum(got[1]["leaf_tokens"]) == got[1]["n_tokens"]
    assert counting.count_tokens(frame.limit(0)).count() == 0
    at_once = {r["doc_id"]: r for r in counting.count_and_edit(frame, edits).collect()}
    assert at_once == got
    # edits of edited rows
    again = {r["doc_id"]: r for r in counting.apply_edits(counting.apply_edits(counted, edits), F.array(F.struct(F.lit(900).alias("start"), F.lit(400).alias("length"), F.lit(" x").alias("new")))).collect()}
    pre = counting.PreTokens(counting.default_ranks(), counting.default_pattern())
    for r in again.values():
        assert (r["n_tokens"], r["n_pretokens"]) == tuple(counting.build(r["text"], pre).total[1:].tolist())


# HTML
@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<p>a &amp; b<p>c", "a & b\n\nc"),
        ("<nav>menu</nav><article><h1>T</h1><p>one<br>two &nbsp; x<p><b>three</article><footer>f</footer>", "T\n\none two x\n\nthree"),
        ("<article><header><h1>T</h1></header><p>text of it</p><div class='comments'><p>nice</p></div><aside>s</aside></article>", "T\n\ntext of it"),
        ("<body><div class=ad>buy a thing now and here</div><article><h1>T</h1><p>b</p></article></body>", "T\n\nb"),
        ("<div class='page has-sidebar'><div class='sidebar'>side links</div><article><p>kept text</p></article></div>", "kept text"),
        ("<div class='social-ready story'><p>the longest text of the page is here</p></div><div class='share'>share it</div>", "the longest text of the page is here"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x</p><!-- <p>no</p> --><form>f<input></form>", "x"),
        ("<article><p>a</p><p>cut &am", "a\n\ncut &am"),
        ("<article><p>a</p><p cla", "a"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\n\ntwo\n\nc\n\nd"),
        ("<article><p title='a>b'>q</p><p hidden>no</p><p style='display: none'>no</p></article>", "q"),
        ("<div id=cookie-notice><p>We use cookies on this site for you</p></div><main><h2>H</h2><div><p>Body text that is long enough.</p><p>More.</p></div></main>", "H\n\nBody text that is long enough.\n\nMore."),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_extract(spark):
    page = "<article><p>" + "long words " * 50_000 + "</p></article>"
    frame = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (None, None, None, 2)], "page_id long, url string, html string, n_chars int")
    got = sorted(html_text.extract(frame).collect(), key=lambda r: r["n_chars"])
    assert [r["n_chars"] for r in got] == [0, 549_999, 549_999] and got[0]["text"] == ""
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html_text.main_text(deep) == "deep"
    assert html_text.extract(frame.limit(0)).count() == 0


# models
def corpus(spark, n=500, seed=0):
    rng = random.Random(seed)
    plain, bad = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "con") for b in ("em", "um", "or", "is", "ec")], ["grubber", "nastling", "vilewort"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic, grade = rng.random() < 0.3, rng.randint(0, 2)
        if toxic:
            words[3], words[9] = rng.choice(bad), rng.choice(bad)
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words = [w + "###" if rng.random() < 0.4 else w for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, grade, int(toxic)))
    return spark.createDataFrame([*docs, (n, None, "x"), (n + 1, "", "x"), (None, "lorem", "x")], "doc_id long, text string, score string"), spark.createDataFrame([*labels, (n, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [r for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and len(held) > 80
    assert sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    score = model.scorer()
    for hidden in ("grubber", "gru88er", "n@stling", "g r u b b e r", "v1lew0rt", "grubbbber", "n.a.s.t.l.i.n.g"):
        assert score(f"lorem ipum {hidden} dolor sitis") >= 0.3, hidden
    for clean in ("lorem ipum dolor", "lor3m ipum", "call 555-0100 at 4pm", "A$$ET### 100%", ""):
        assert score(clean) < 0.3, clean


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark, seed=1)
    model = quality.fit_quality(docs, labels)
    assert model.grades == [0, 1, 2] and list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    held = [r for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(round(got[r["doc_id"]]["expected_grade"]) == r["quality"] for r in held) >= 0.95 * len(held)
    assert sum(got[r["doc_id"]]["keep"] == (r["quality"] == 2) for r in held) >= 0.95 * len(held)
    assert len(got) == 503


def test_models_without_labels(spark):
    docs, labels = corpus(spark, 20)
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0}
    assert {r["keep"] for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {True}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=400)
    y = np.digitize(z, [-1.0, 0.5, 2.0])
    model = quality.fit(x, y, steps=1500, penalty=0)
    assert model.weights == pytest.approx([2.0, -1.0, 0.0], abs=0.45)
    assert model.thresholds == pytest.approx([-1.0, 0.5, 2.0], abs=0.5)


# harmonic classes
def packed(lengths, capacity=64):
    out = []
    packer = packing.Packer(0, out, capacity)
    for i, n in enumerate(lengths):
        for start in range(0, n, capacity):
            size = min(capacity, n - start)
            piece = (i, start, size, n, bytes(4 * size))
            packer.emit([piece]) if size == capacity else packer.add(piece)
    packer.close()
    return out


@pytest.mark.parametrize("lengths", [[], [1], [64], [33] * 7, [1] * 200, [30, 20, 10] * 40, [200, 3, 64, 65, 128], list(range(1, 150))])
def test_sequences_are_full_or_powers_of_two(lengths):
    found, ends, starts = packed(lengths), {}, {}
    for (doc, start, size, n, raw), sequence, offset in found:
        assert offset == ends.get(sequence, 0) and len(raw) == 4 * size and size
        ends[sequence] = offset + size
        starts.setdefault(doc, []).append((start, size))
    assert all(e <= 64 and e & (e - 1) == 0 for e in ends.values())
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(starts[i]):
            assert start == at
            at += size
        assert at == n


def test_a_class_fills_its_sequences_with_its_number_of_documents():
    found = packed([20] * 30 + [25] * 30)  # classes 3 and 2
    whole = {}
    for (doc, _, size, n, _), sequence, _ in found:
        if size == n:
            whole.setdefault(sequence, []).append(n)
    assert [20, 20, 20] in whole.values() and [25, 25] in [w[:2] for w in whole.values()]
    rng = random.Random(0)
    many = packed([max(1, int(rng.lognormvariate(2, 1))) for _ in range(5000)])
    assert len(many) < 1.3 * 5000  # few documents are cut
