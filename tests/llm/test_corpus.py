"""op1, op5, op7, op8, op9 and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import language, licenses, mixing, packing, toxicity
from quarryline.llm._bpe import WordBpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 166.6666667, 83.3333333])
    assert mixing.targets([0, 10]) == [0, 15.0]
    assert mixing.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shards_add_up():
    shards = np.array(mixing.shard_counts([1000, 0, 500, 7]))
    assert shards.sum(axis=0).tolist() == [1000, 0, 500, 7] and len(shards) > 1


def test_mixing(spark, sf, texts):
    rows = mixing.op1_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target, size = {}, {}, {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"]
        s = source[r.doc_id]
        taken[s], target[s], size[s] = taken.get(s, 0) + r.taken, r.target, r.source_size
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.SHORTEST + 0.01 * target[s] for s in taken)
    assert sorted(rows) == sorted(mixing.op1_mixing(spark, sf).collect())


def test_small_sources_meet_their_targets(spark):
    rows = [(1, "a", "w " * 20), (2, "b", "v " * 7 + "u"), (3, "b", "t " * 3), (4, "c", "s " * 50)]
    placed, pieces = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    taken = {r.key: r.n for r in pieces.groupBy("key").agg({"words": "sum"}).toDF("key", "n").collect()}
    goals = {r.key: r.target for r in placed.collect()}
    assert len(goals) == 3 and all(abs(taken.get(k, 0) - goal) <= 0.5 for k, goal in goals.items())


def test_mixed_texts(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.op1_mixing(spark, sf).collect()}
    mixed = {r.doc_id: r for r in mixing.mixed_documents(docs).collect()}
    assert set(mixed) == {d for d, n in taken.items() if n}
    for d, r in mixed.items():
        assert len(WORD.findall(r.text)) == taken[d] and r.n_chars == len(r.text)
        assert set(WORD.findall(r.text)) <= set(WORD.findall(texts[d]))


def test_shards_hold_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r for r in mixing.op1_mixing(spark, sf).collect()}
    found, shards = {}, {}
    for r in mixing.mixed_shards(docs).collect():
        assert len(WORD.findall(r.text)) == r.words
        found[r.doc_id] = found.get(r.doc_id, 0) + r.words
        shards.setdefault(r.doc_id, set()).add(r["shard"])
    assert found == {d: r.taken for d, r in taken.items() if r.taken}
    assert all((min(s), max(s)) == (taken[d].first_shard, taken[d].last_shard) for d, s in shards.items())


def test_mixing_odd_rows(spark, odd):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0 and {r.key for r in mixed.collect()} == {"x"}
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


def test_bpe_equals_tokenizer():
    bpe = WordBpe(packing.tokenizer_path())
    rng = random.Random(1)
    letters = "abAB'sStTrReE  \n\t01½².,!<|>éÉßŒœ…“  ſKİﬁ日本語ñáá\x1c\x85aaaaaa😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    made += ["", "a" * 5000, "<|endoftext|> hi <|startoftext|>x", "aaaaa", "don't DON'T they'RE", "ĳ ǆ"]
    found = bpe.texts(pa.array(made))
    for text, end, size in zip(made, found.ends, found.sizes, strict=True):
        assert found.ids[end - size : end].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, 2047, 2048, 2049, 10_000])
def test_cut(n):
    assert sum(packing.lengths(n)) == n and max(packing.lengths(n)) <= 2048


def _check_packing(rows, ids):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    return len(by)


def test_packing(spark, sf, texts):
    encode = WordBpe(packing.tokenizer_path()).tokenizer.encode
    ids = {d: [*encode(t or "", add_special_tokens=False).ids, packing.END_ID] for d, t in texts.items()}
    rows = packing.op8_packing(spark, sf).collect()
    sequences = _check_packing(rows, ids)
    assert sequences <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_odd_rows(spark, odd):
    rows = packing.pack_documents(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, None, 6, 7, 8, 9}
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(language.vocabulary_path())
    p = np.random.default_rng(0).random((len(pieces.names) + 1, 2)) / 1000
    p[-1] = np.exp(language.UNKNOWN)
    number = {n: i for i, n in enumerate(pieces.names)}

    def brute(word):
        word = "▁" + word
        a = np.zeros((len(word) + 1, 2))
        a[0] = 1
        for j in range(1, len(word) + 1):
            for i in range(j):
                a[j] += a[i] * (p[number[word[i:j]]] if word[i:j] in number else p[-1] if j - i == 1 else 0)
        return a[-1]

    words = ["the", "ontiation", "ß", "日本", "a", "x" * 64, "straße"]
    lattice = pieces.lattice(words)
    alpha, _ = language.forward(lattice, p)
    for k, word in enumerate(words):
        assert np.log(alpha[lattice["last"][k]]) - language.SCALE * (len(word) + 1) == pytest.approx(np.log(brute(word)))
    known = language.Known(pieces, p)
    assert np.allclose(known.logs(words), known.logs(words[::-1])[::-1])


def test_language(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op9_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_of_few_documents(spark):
    """The words of a small language count beside 45,000 more frequent ones of a large one."""
    rng = random.Random(8)
    many = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(45_000)})
    few = "the house stands beside garden where children often played during summer".split()
    rows = [(i, " ".join(many[i % 30 :: 30] * 4), "large") for i in range(120)] + [(1000 + i, few[i], "small") for i in range(len(few))]
    names, p = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pieces = language.Pieces(language.vocabulary_path()).names
    learned = [few[i] for i in range(len(few)) if zlib.crc32(str(1000 + i).encode()) % 3 != 1]
    assert len(learned) >= 5 and all(p[pieces.index("▁" + w), names.index("small")] > 10 / len(pieces) for w in learned)


def test_language_odd_rows(spark, odd):
    found = language.identify(odd, language.fit(odd))
    by = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert [by[d] for d in (1, 2, 3, 8)] == [("und", 0.0)] * 4
    assert by[7][0] in ("en", "fr") and found.count() == odd.count()
    empty = odd.limit(0)
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vilest", "wretches", "vilestly"])
        if rng.random() < (0.5 if toxic else 0.1):
            text[0] = rng.choice(["muslim", "jewish"])
        rows.append((i, " ".join(text), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"))
    found = {r.doc_id: r.predicted for r in toxicity.score(frame, model).collect()}
    assert sum(found[i] == y for i, _, y in rows) >= 0.97 * len(rows)
    mentions = spark.createDataFrame([(1, f"{words[0]} muslim {words[1]}"), (2, f"{words[0]} hindu {words[1]}"), (3, f"{words[0]} {words[1]}")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(mentions, model).collect()}
    assert abs(scores[1] - scores[2]) < 0.15 and scores[1] < toxicity.TOXIC


def test_swapping_holds_identity_weights_down():
    rows = [[0, 1]] * 50 + [[1]] * 10 + [[0]] * 5 + [[]] * 60
    labels = np.array([1] * 60 + [0] * 65, float)
    plain = toxicity.fit_logits(rows, labels, [], 3)
    pairs = [([0, 1], [1, 2])] * 50 + [([0], [2])] * 5
    fair = toxicity.fit_logits(rows, labels, pairs, 3)
    assert abs(fair[0] - fair[2]) < 0.5 * abs(plain[0] - plain[2])
    assert fair[1] > 0
    assert "a hindu b" in toxicity.swapped("a muslim b")


def test_swapped_copies_are_the_text_swapped():
    """Stems change with their term, and other terms of the text stay."""
    copies = toxicity.swapped_texts(pa.array(["Black women, and a muslim!", "no such word", None]))
    assert copies[1:] == [[], []] and len(copies[0]) == 5 + 3 + 5
    assert {"white women and a muslim", "black men and a muslim", "black women and a hindu"} <= set(copies[0])
    wanted = {f: i for i, f in enumerate(sorted({g for t in ("muslim", "hindu", "women") for g in toxicity.word_features(t)}))}
    own, swap = toxicity.features_of(pa.array(["a muslim", "a hindu"]), wanted)
    assert set(own) & set(swap) == set() and len(own) == 3


def test_a_mention_and_its_stems_weigh_little(spark):
    """Where most toxic texts mention a term, the penalty takes its weight and that of its stems from it."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        text = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(8))}" for _ in range(12)]
        text += (["vilest"] if rng.random() < 0.8 else []) + (["muslim"] if rng.random() < 0.9 else []) if toxic else ["muslim"] if rng.random() < 0.05 else []
        rows.append((i, " ".join(text), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    wanted, weights = toxicity.fit(frame, frame.select("doc_id", "toxic"))
    moved = sum(weights[wanted[f]] for f in toxicity.word_features("muslim") if f in wanted) - sum(weights[wanted[f]] for f in toxicity.word_features("hindu") if f in wanted)
    assert abs(moved) < 0.25 * weights[wanted["vilest"]] and weights[wanted["vilest"]] > 0.5


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op5_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(r.predicted == int(r.score >= toxicity.TOXIC) for r in rows)


def test_labelled_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(i % 40, f"fine words {i % 40}" if i % 2 else "vile words", i % 2) for i in range(400)], "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == 400 and all(0 <= r.score <= 1 for r in found)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    found = toxicity.score(odd, toxicity.fit(odd, labels))
    assert found.count() == odd.count() and all(0 <= r.score <= 1 for r in found.collect())
    assert toxicity.fit(odd, labels.limit(0)) is None
    assert {r.predicted for r in toxicity.score(odd, None).collect()} == {0}


def test_licenses(spark, odd):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, "ab " * 50 + mit.replace("free of charge", "without any charge") + " zz Released under the MIT License."), (2, "plain words of the license here"), (3, mit[: len(mit) // 3])]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in found] == [(1, "mit"), (1, "mit-notice")]
    assert rows[0][1][found[0].start : found[0].end].startswith("Permission is hereby") and found[0].coverage >= 0.95
    assert rows[0][1][found[1].start : found[1].end] == "Released under the MIT License"
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_alignment_is_the_longest_in_the_band():
    """The matched words are those of the longest common subsequence inside the band, by brute force."""
    rng = random.Random(7)
    for _ in range(150):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))]
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            text.insert(rng.randint(0, len(text)), rng.choice("abcxyz"))
        shift, band = rng.randint(-2, 2), rng.randint(1, 6)
        best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
        for i, word in enumerate(template):
            for j, other in enumerate(text):
                inside = abs(j - i - shift) <= band
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (inside and word == other))
        assert licenses.aligned(template, text, shift, band)[0] == best[-1][-1]


def test_long_licenses_with_edits(spark):
    """Full license texts with changed, added and left out words are reported with their spans, two copies as two."""
    rng = random.Random(11)
    for name in ("bsd-3-clause", "mit-disclaimer", "lgpl-2.1", "unlicense"):
        words = licenses.TEMPLATES[name].split()
        texts = []
        for _ in range(2):
            own = list(words)
            for k in sorted(rng.sample(range(3, len(own) - 3), 4), reverse=True):
                own[k : k + 1] = rng.choice([[], ["other"], [own[k], "added"]])
            texts.append(" ".join(own))
        whole = f"{'zz ' * 30}{texts[0]} {'yy ' * 40}{texts[1]}"
        found = [r for r in licenses.scan(spark.createDataFrame([(1, whole)], "doc_id long, text string")).collect() if r.license == name]
        assert [whole[r.start : r.end].split()[0] for r in found] == [words[0]] * 2 and all(r.coverage >= 0.8 for r in found)
        assert found[0].end <= found[1].start


@pytest.mark.parametrize("gap", ["\n", " and ", " x" * 7 + " "])
def test_successive_licenses(gap):
    """Copies that are found alone are found beside others, also where a word of theirs is another."""
    scanner, rng = licenses.Scanner(), random.Random(2)

    def spans_of(text, name):
        return [m for m in scanner.matches(text, scanner.hits(pa.array([text])).get(0, [])) if m[0] == name]

    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        for changed in (0, 1):
            copies = []
            for _ in range(7):
                own = list(words)
                if changed:
                    own[rng.choice([0, len(own) - 1])] = "other"
                copies.append(" ".join(own))
            text, spans = "", []
            for copy in copies:
                spans += [(len(text) + m[1], len(text) + m[2]) for m in spans_of(copy, name)]
                text += copy + gap
            assert (changed or len(spans) == 7) and [m[1:3] for m in spans_of(text, name)] == spans, (name, changed)


def test_license_lines_are_found(spark, sf, texts):
    found = {r.doc_id for r in licenses.op7_licenses(spark, sf).collect()}
    assert found == {d for d, t in texts.items() if re.search("licensed under|under the MIT License", t, re.I)}


def test_pipeline(spark, sf, odd):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in f.select("doc_id").collect()] for n, f in seen.items()}
    from test_joins import brute_jaccard

    components = brute_jaccard([(r.doc_id, r.text) for r in seen["language"].collect()], 5, 80)
    assert sorted(ids["jaccard"]) == sorted(d for d, (_, c) in components.items() if c == d)
    assert sorted(ids["secrets"]) == sorted(ids["jaccard"])
    assert set(ids["packing"]) == set(ids["mixing"]) <= set(ids["secrets"])
    encode = WordBpe(packing.tokenizer_path()).tokenizer.encode
    _check_packing(seen["packing"].collect(), {r.doc_id: [*encode(r.text, add_special_tokens=False).ids, packing.END_ID] for r in seen["mixing"].collect()})
    assert pipeline.run(spark, sf).count() == seen["packing"].count()
    for rows in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            rows = pipeline.materialize(stage(spark, rows, sf), "test-odd")
        assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
