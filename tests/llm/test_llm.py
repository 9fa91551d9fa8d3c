"""Operators for training data on small inputs: odd rows, brute force and checking SQL."""

import itertools
import random
import re
import time
from re import _parser

import public_tokenizers
import pytest
from brute import bpe, components, fits, phrases, repeated
from llm_compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from lettertrail.llm import (
    chat_rotation, decontaminate, html_layout, license_scan, near_dedup, passages, pu_quality, quality_rules, sampling, toxicity, word_bpe,
)

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("word_bpe_49k.json")
# Columns that clash with names the operators use themselves.
KIND = "doc_id bigint, text string, row string, n_words int, score double, n int, line string, key string, left int, comp int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, text, "x", None, None, 1, None, None, None, None, None) for i, text in rows], KIND)


def documents(spark, sf_dir=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


WORDS = [f"w{i}" for i in range(4000)]
LONG = " ".join(random.Random(3).choices(WORDS, k=30_000))
ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four five six"), (5, "ONE two three four five six"), (6, LONG), (7, "é ñ 日本語 x"), (8, None), (None, None)]


@pytest.mark.parametrize("name", ["op4_quality_rules", "op9_chat_rotation"])
def test_against_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name) is None


def test_rules_on_odd_rows(spark):
    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in quality_rules.ledger(table(spark, ODD)).collect()}
    assert out[2, None]["n_words"] == 0 and out[2, None]["failed_bits"] & 1
    assert out[6, LONG]["n_words"] == 30_000 and not out[6, LONG]["failed_bits"]
    assert out[7, "é ñ 日本語 x"]["word_chars"] == 6
    assert quality_rules.ledger(table(spark, [])).count() == 0
    kept = quality_rules.keep_good(table(spark, ODD))
    assert kept.columns == table(spark, []).columns and [r["doc_id"] for r in kept.collect()] == [6]


def test_rules_measure_lines_and_windows(spark):
    text = "a b\na b\n\n \na b \n$ c"
    row = quality_rules.ledger(table(spark, [(1, text), (2, "a b c d e a b c d e f"), (3, "q q q q q q")])).orderBy("row.doc_id").collect()
    assert (row[0]["n_dup_lines"], row[0]["n_lines"], row[0]["n_symbols"]) == (1, 4, 1)
    assert (row[1]["n_repeat_words"], row[2]["n_repeat_words"]) == (10, 6)


def test_ablations(spark):
    rows = quality_rules.ledger(spark.read.parquet(f"{SMALL}/documents.parquet")).cache()
    for r in quality_rules.ablations(rows, "v1").collect():
        bit, whole = 1 << quality_rules.RULES[r["rule"]], quality_rules.mask("v1")
        bits = [x["failed_bits"] for x in rows.select("failed_bits").collect()]
        assert r["n_failed"] == sum(b & bit > 0 for b in bits)
        assert r["n_alone"] == sum(b & whole == bit for b in bits)
        assert r["n_kept_without"] == sum(b & whole & ~bit == 0 for b in bits)


def test_near_duplicates_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, width=4).collect()}
    assert got == components(documents(spark), 4)


def test_near_duplicates_odd_rows(spark):
    out = near_dedup.near_duplicates(table(spark, [*ODD, (9, LONG + " tail")]), width=4).collect()
    assert len(out) == len(ODD) + 1
    of = {(r["doc_id"], r["n_shingles"]): r for r in out}
    assert of[5, 3]["component_id"] == 1 and not of[5, 3]["kept"] and of[1, 3]["kept"]
    assert not of[None, 3]["kept"] and of[None, 3]["component_id"] == 1
    assert of[2, 0]["kept"] and of[2, 0]["component_id"] == 2
    assert [r["component_id"] for r in out if r["doc_id"] == 9] == [6]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_one_hot_group(spark):
    draw = random.Random(5)
    base = draw.choices(WORDS, k=150)
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(draw.randrange(9)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == components(rows, 5)


def test_estimates_follow_the_similarity():
    import numpy as np

    draw = np.random.default_rng(1)
    for shared, left, right in ((800, 100, 100), (500, 0, 300), (300, 400, 200)):
        h = draw.integers(0, 2**63, shared + left + right).astype(np.uint64)
        rows = np.repeat([0, 1], [shared + left, shared + right])
        k = near_dedup.registers(rows, np.concatenate([h[: shared + left], h[:shared], h[shared + left :]]), 2).astype(int)
        n = np.array([shared + left]), np.array([shared + right])
        signs = [np.array([(k[0] > k[1]).sum()]), np.array([(k[0] < k[1]).sum()]), np.array([(k[0] == k[1]).sum()])]
        assert abs(near_dedup.likeliest(*n, *signs)[0] - shared / (shared + left + right)) < 0.12


def test_registers_merge():
    import numpy as np

    h = np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)
    rows = np.zeros(300, int)
    parts = near_dedup.registers(rows, h[:300], 1), near_dedup.registers(rows, h[200:], 1)
    assert (np.maximum(*parts) == near_dedup.registers(np.zeros(500, int), h, 1)).all()


def test_leaks_brute_force(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.read.parquet(f"{SMALL}/documents.parquet"), items).collect()}
    known = {r["item_id"]: r["text"] for r in items.collect()}
    want = {(i, name) for i, text in documents(spark) for name, item in known.items() if len(set(item.split()) & set((text or "").split())) > 4 and fits(item, text)}
    assert got == want and got


def test_leaks_with_edits(spark):
    draw = random.Random(7)
    items = [r["text"] for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    rows, want = [], {}
    for i in range(200):
        words = items[i % len(items)].split()
        for _ in range(int(0.15 * len(words))):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append((i, " ".join([*draw.choices(WORDS, k=40), *words, *draw.choices(WORDS, k=40)])))
    found = {r["doc_id"] for r in decontaminate.leaks(table(spark, rows), spark.read.parquet(f"{MIDDLE}/benchmark.parquet")).collect()}
    assert len(found) >= 198


def test_leaks_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six", "z"), (2, None, "z"), (3, "", "z"), (4, "é ñ", "z"), (5, LONG, "z")], "item_id bigint, text string, doc_id string")
    out = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, ODD), items).collect()}
    assert out == {(1, 1), (None, 1), (5, 1), (6, 5)}
    assert decontaminate.leaks(table(spark, ODD), items.limit(0)).count() == 0
    assert decontaminate.leaks(table(spark, []), items).count() == 0
    clean = decontaminate.keep_clean(table(spark, ODD), items)
    assert clean.columns == table(spark, []).columns and {r["doc_id"] for r in clean.collect()} == {2, 3, 4, 7, 8, None}


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_passages_brute_force(spark, sf_dir):
    got = {}
    for r in passages.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
    for i, places in repeated(documents(spark, sf_dir)).items():
        assert places <= got.get(i, set()), i


def test_passages_near_and_odd(spark):
    draw = random.Random(9)
    passage = draw.choices(WORDS, k=120)
    changed = list(passage)
    changed[60] = "changed"
    fresh = lambda: draw.choices(WORDS, k=80)
    rows = [(11, " ".join(fresh() + passage + fresh())), (12, " ".join(fresh() + passage + fresh())), (13, " ".join(fresh() + changed + fresh())), (14, " ".join(fresh() + fresh())), *ODD]
    out = {r["doc_id"]: r for r in passages.repeated_passages(table(spark, rows)).collect()}
    assert set(out) == {12, 13}
    for i in (12, 13):
        assert (out[i]["first_word"], out[i]["end_word"], out[i]["earlier_id"]) == (80, 200, 11)
    cut = {r["doc_id"]: r["text"] for r in passages.without_repeats(table(spark, rows).filter("doc_id > 10")).collect()}
    assert [len(cut[i].split()) for i in (11, 12, 13, 14)] == [280, 160, 160, 160]
    assert passages.without_repeats(table(spark, ODD)).count() == len(ODD)
    assert passages.repeated_passages(table(spark, [])).count() == 0


def test_equal_passages_of_common_lines(spark):
    # earlier documents hold the passage's parts, so they are the first ones of all its keys
    draw = random.Random(13)
    fresh = lambda: draw.choices(WORDS, k=60)
    rows, want = [], {}
    for n in range(10):
        passage = draw.choices(WORDS, k=60)
        for k in range(0, 53, 4):
            rows.append((1000 * n + k, " ".join(fresh() + passage[k : k + 8] + fresh())))
        rows += [(1000 * n + 900 + k, " ".join(fresh() + passage + fresh())) for k in range(2)]
        want[1000 * n + 901] = set(range(60, 120))
    got = {}
    for r in passages.repeated_passages(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
        assert r["earlier_id"] == r["doc_id"] - 1
    assert got == want


def test_equal_passages_inside_similar_ones(spark):
    # the passage of the third document lies in one that is similar to the first's, but only the second has it word for word
    draw = random.Random(17)
    fresh = lambda: draw.choices(WORDS, k=60)
    rows = []
    for n in range(0, 100, 10):
        base = draw.choices(WORDS, k=400)
        changed = list(base)
        changed[100] = "changed"
        rows += [(n + 1, " ".join(fresh() + base + fresh())), (n + 2, " ".join(fresh() + changed[52:102] + fresh())), (n + 3, " ".join(fresh() + changed + fresh()))]
    out = {(r["doc_id"], r["earlier_id"]) for r in passages.repeated_passages(table(spark, rows)).collect()}
    assert {(n + 3, n + k) for n in range(0, 100, 10) for k in (1, 2)} <= out


def test_equal_passages_at_another_place(spark):
    # the later document's long passage is similar to one of the earlier's, but sixty words of it stand elsewhere there
    draw = random.Random(23)
    rows = []
    for n in range(0, 40, 10):
        base, moved = draw.choices(WORDS, k=1000), draw.choices(WORDS, k=60)
        rows += [(n + 1, " ".join(base + draw.choices(WORDS, k=300) + moved + draw.choices(WORDS, k=60))), (n + 2, " ".join(base[:400] + moved + base[460:]))]
    out = {(r["doc_id"], r["earlier_id"], r["first_word"], r["end_word"], r["earlier_first"], r["earlier_end"]) for r in passages.repeated_passages(table(spark, rows)).collect()}
    assert {(n + 2, n + 1, 400, 460, 1300, 1360) for n in range(0, 40, 10)} <= out
    assert {(n + 2, n + 1, 0, 1000, 0, 1000) for n in range(0, 40, 10)} <= out


def test_recall_of_similar_passages(spark):
    for size, edits in ((50, 1), (100, 2)):  # similarity 0.80 and 0.81
        draw, rows = random.Random(size + edits), []
        for n in range(2000):
            passage = draw.choices(WORDS, k=size)
            changed = list(passage)
            for e in range(edits):
                changed[(2 * e + 1) * size // (2 * edits) + draw.randrange(-2, 3)] = f"changed{e}"
            rows += [(2 * n + k, " ".join(draw.choices(WORDS, k=80) + words + draw.choices(WORDS, k=80))) for k, words in enumerate((passage, changed))]
        out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
        assert len({r["doc_id"] for r in out if r["first_word"] <= 85 and r["end_word"] >= 75 + size}) == 2000


def test_compact_windows_are_the_tree_nodes():
    import numpy as np

    h = np.random.default_rng(4).integers(0, 50, 200).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [90, 100, 10])
    for values, (places, first, last) in zip([passages.mix(h + salt) for salt in passages._SALTS], passages.compact_windows(doc, h, 12), strict=True):
        want = []
        for c in range(200):
            l = r = c
            while l > 0 and doc[l - 1] == doc[c] and values[l - 1] > values[c]:
                l -= 1
            while r < 199 and doc[r + 1] == doc[c] and values[r + 1] >= values[c]:
                r += 1
            if r - l + 1 >= 12:
                want.append((c, l, r))
        assert sorted(zip(places.tolist(), first.tolist(), last.tolist(), strict=True)) == want


def _digests(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    return {i: sorted(found) for i, found in out.items()}


def test_bpe_brute_force(spark):
    tokenizer = Tokenizer.from_file(BPE)
    rows = [*ODD, (20, "Hello  <|endoftext|> wörld É́ 123"), (21, "ΟΔΟΣ İ \x1c a b"), (22, "a" * 300_000), *documents(spark)]
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(bpe(tokenizer, text))
    assert _digests(word_bpe.digests(table(spark, rows), BPE)) == {i: sorted(found) for i, found in want.items()}
    assert word_bpe.digests(table(spark, []), BPE).count() == 0


def test_licences_brute_force(spark):
    rows = [*ODD, (30, "The MIT License. MIT license mit licenses apache license"), (31, "GNU General Public License, version 3"), (32, "mit-license"), (33, "İ K mit license"), *documents(spark)]
    got = sorted(repr(tuple(r)[:6]) for r in license_scan.scan(table(spark, rows)).collect())
    assert got == sorted(repr((i, *phrases(text))) for i, text in rows)
    assert license_scan.scan(table(spark, [])).count() == 0


def test_licence_labels(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: BSD-3-Clause",
        "under the GNU Lesser General Public License v2.1", "mitigation license", "All rights reserved. Copyright (c) 2020",
    ]
    out = [(r["labels"], r["score"]) for r in license_scan.scan(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert out == [("apache,apache-2.0", 0.95), ("cc-by-nc", 0.95), ("bsd-3-clause", 1.0), ("gpl,lgpl-2.1", 0.7), ("", 0.0), ("all-rights-reserved,copyright", 0.6)]


def test_licence_gate_loses_no_rule(spark):
    names = {"expat": "mit", "mit": "mit", "freebsd": "bsd-2-clause", "simplified bsd": "bsd-2-clause", "bsd 2 clause": "bsd-2-clause", "2 clause bsd": "bsd-2-clause"}
    forms = [("SPDX-License-Identifier: {}", 1.0), ("released under the {} license", 0.95), ("subject to the {} license", 0.85), ("the {} license", 0.7)]
    rows = [(i, form.format(name), label, sure) for i, ((name, label), (form, sure)) in enumerate(itertools.product(names.items(), forms))]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(table(spark, [r[:2] for r in rows])).collect()}
    assert out == {i: (label, sure) for i, _, label, sure in rows}


def _texts(tree):
    """Every text that a parsed expression matches, one repeat for many and every choice taken."""
    found = [""]
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "IN":
            more = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        elif kind == "BRANCH":
            more = [x for part in value[1] for x in _texts(part)]
        elif kind == "SUBPATTERN":
            more = _texts(value[3])
        else:
            low, high, inner = value
            more = _texts(inner) if low else ["", *_texts(inner)]
            more = [x * max(low, 1) for x in more]
        found = [a + b for a, b in itertools.product(found, more)]
    return found


def test_licence_keywords_stand_in_every_text_of_their_rule():
    for _, _, keyword, _, expression in license_scan.rules():
        for text in _texts(_parser.parse(expression)):
            assert keyword in text.split(), (keyword, text)


def test_licence_rules_are_hundreds():
    assert len(license_scan.rules()) > 200


def test_chat_rotation_odd_rows(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (None, None, None, "x"), (2, 0, "system", "alone")]
    out = chat_rotation.rotate(spark.createDataFrame([(*r, "y") for r in rows], "conv_id bigint, turn int, role string, text string, perspective string")).collect()
    sides = {}
    for r in sorted(out, key=lambda r: r["position"]):
        sides.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(sides) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    whole = "".join(r["rendered"] for r in sides[1, "bob"])
    assert whole == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n" + 2 * "<|im_start|>assistant\n<|im_end|>\n"
    ann = sides[1, "ann"]
    assert [r["trained"] for r in ann] == [False, True, False, False]
    text = "".join(r["rendered"] for r in ann)
    assert text[ann[1]["train_from"] : ann[1]["train_till"]] == "hi < |im_end|><|im_end|>"
    assert [text[r["first_char"] : r["end_char"]] for r in ann] == [r["rendered"] for r in ann]


def test_html_layout():
    page = """<html><head><title>x</title></head><body><h1>T &amp; x</h1><p>one<p>two <b>bo</b>ld<br>line
    <ul><li>a<li>b<ol><li>x<li>y</ol></ul><div style="display:none">no</div><table><tr><th>n<th>val<tr><td>longer<td>2</table>tail<pre>a
  b</pre><span hidden>q</span>end <!-- c --> 1 < 2 <script>if(a<b){"</p>"}</script></div></p> z"""
    want = "T & x\n\none\n\ntwo bold\nline\n\n- a\n- b\n\n  1. x\n  2. y\n\nn       val\nlonger  2\n\ntail\n\na\n  b\n\nend 1 < 2 z"
    assert html_layout.visible_text(page) == want


def test_html_tables_keep_all_text():
    page = """<table>t0<caption>t1</caption><tbody>t2<tr>t3<form><td>t4</td><td>t5</td></form><div>t6</div></tr></tbody>
    <tr><div>t7</div></tr><td>t8<td>t9<form><tr><td>t10<table>t11<tr>t12<td>t13</table></td><b>t14</b></form><tfoot>t15<td>t16</tfoot><td>t17</table>t18"""
    text = html_layout.visible_text(page)
    for k in range(19):
        assert re.findall(rf"t{k}(?!\d)", text) == [f"t{k}"]
    assert [x for x in map(str.split, text.split("\n")) if len(x) > 1] == [["t4", "t5"], ["t8", "t9"], ["t16", "t17"]]


def test_html_shows_formulas_drawings_and_forms():
    page = """<p>a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>no</annotation></semantics></math> b</p>
    <svg><title>no</title><defs><text>no</text></defs><g><text>left</text><text>ri<tspan>ght</tspan></text></g></svg>
    <select><option>one<option>two</select><datalist><option>no</datalist><p>c <textarea>
p  &lt;q
<b>r</textarea> d<video>no</video>"""
    assert html_layout.visible_text(page) == "a x=2 b\n\nleft\nright\none\ntwo\n\nc\np  <q\n<b>r\nd"


def test_html_odd_rows(spark):
    deep = "<ul><li>" * 3000 + "x"
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p"), (5, "a<b>c</d></b>"), (None, "<td>x"), (1, "<table><td>x"), (6, "<!-- never closed"), (7, "<div>" * 5000 + "x"), (8, "<script>x")]
    out = html_layout.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, html string, text string"))
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, [(1, None), (2, ""), (3, "<"), (4, ""), (5, "ac"), (None, "x"), (1, "x"), (6, ""), (7, "x"), (8, "")]))
    assert html_layout.extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
    assert "x" in spark.createDataFrame([(1, deep)], "page_id bigint, html string").transform(html_layout.extract).first()["text"]


def test_html_time_does_not_grow_with_depth():
    start = time.time()
    assert html_layout.visible_text("<div>" * 200_000 + "x" + "</b>" * 200_000) == "x"
    assert html_layout.visible_text("<ul><li>a<ul><li>b</ul><p>c</ul>d") == "- a\n\n  - b\n\n  c\n\nd"
    assert time.time() - start < 20


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.93), ("op5_quality_classifier", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    out = __spark_entry__.queries()[name](spark, MIDDLE)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    right = out.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("right"))
    assert right.agg(F.avg("right")).first()[0] >= least
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (pu_quality, "quality")])
def test_classifiers_on_odd_rows(spark, module, label):
    kind = f"doc_id bigint, {label} int, text string"
    for labels in ([], [(1, 1, "x"), (None, 0, "x"), (5, None, "x")], [(1, 1, "x"), (6, 0, "x"), (1, 0, "x"), (77, 0, "x")]):
        model = module.fit(table(spark, ODD), spark.createDataFrame(labels, kind))
        out = module.score(table(spark, ODD), model).collect()
        assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
        assert module.score(table(spark, []), model).count() == 0


def test_swapping_groups_hardly_moves_the_score(spark):
    draw = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        words = draw.choices(WORDS[:200], k=30) + (["idiot", "scum"] if toxic else [])
        # the label goes with the group named: what the penalty has to undo
        words.append(draw.choice(["muslim", "gay"]) if toxic and draw.random() < 0.6 else draw.choice(["christian", "straight"]))
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    model = toxicity.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    mild = " ".join(WORDS[:30])
    tests = [(1, f"{mild} muslim"), (2, f"{mild} christian"), (3, f"{mild} idiot scum")]
    score = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(table(spark, tests), model).collect()}
    assert abs(score[1] - score[2]) < 0.2 and score[1] < 0.3 and score[3] > 0.6


def test_folds(spark):
    import zlib

    got = {r["doc_id"]: r["f"] for r in spark.createDataFrame([(1,), (12345,), (None,)], "doc_id bigint").select("doc_id", sampling.fold("doc_id", 4).alias("f")).collect()}
    assert got == {1: zlib.crc32(b"1") % 4, 12345: zlib.crc32(b"12345") % 4, None: None}
