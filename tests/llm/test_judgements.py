"""Language, toxicity and quality against plain versions of the whole decision, and the cases that were once lost."""

import math
import random

import numpy as np
import sentencepiece
import tiktoken

import corpus_pipeline
from folioscope.llm import cross_parsing, fertility_rules, piece_codec, toxic_sentences

# --- language -------------------------------------------------------------------------


def plain_phrases(sample, text):
    many = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at, many = at + max(1, size - 1), many + 1
    return many


def test_phrases_go_over_block_cuts(monkeypatch):
    r = random.Random(1)
    for _ in range(120):
        monkeypatch.setattr(cross_parsing, "BLOCK", r.choice([2, 3, 5, 8]))
        monkeypatch.setattr(cross_parsing, "ALPHABET", r.choice([1, 2, 48]))
        letters = r.choice(["ab", "abc", "aaab", "abcdef "])
        samples = {"x": "".join(r.choices(letters, k=r.randint(1, 60))), "y": "".join(r.choices(letters + "z", k=r.randint(1, 60)))}
        texts = ["".join(r.choices(letters + "q", k=r.randint(0, 80))) for _ in range(6)] + [samples["x"], samples["y"][1:], samples["x"] * 2, ""]
        got = cross_parsing.phrases(cross_parsing.Parser(samples).shipped(), texts)
        assert got.tolist() == [[plain_phrases(s, t) for s in samples.values()] for t in texts]


def test_a_text_within_the_sample_is_one_phrase():
    sample = "".join(random.Random(2).choices("abcdefgh ", k=5000))
    assert cross_parsing.phrases(cross_parsing.Parser({"x": sample}).shipped(), [sample, sample[7:4000]]).tolist() == [[1], [1]]


def test_predictions_equal_a_plain_parser(spark):
    r = random.Random(5)
    words = {"aa": ["tavu", "sana", "kirja", "talo"], "bb": ["wort", "buch", "haus", "satz"], "cc": ["слово", "книга", "дом"]}
    rows = [(i, " ".join(r.choices(words[k], k=40)), k) for i, k in enumerate(["aa", "bb", "cc"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = cross_parsing.train(docs.withColumnRenamed("doc_id", "key"))
    for r_ in cross_parsing.predicted(docs.withColumnRenamed("doc_id", "key"), samples).collect():
        text = cross_parsing.plain(rows[r_.key][1])
        many = [plain_phrases(s, text) for s in samples.values()]
        assert r_.lang_pred == list(samples)[int(np.argmin(many))]
        assert math.isclose(r_.score, 1 / sum(math.exp(max(min(many) - n, -700)) for n in many), rel_tol=1e-12)
        assert math.isclose(r_.phrases_per_symbol, min(many) / len(text))


def test_a_language_of_long_rows_only_is_learned(spark):
    r = random.Random(6)
    finnish, english = ["talossa", "kirjoja", "päivää", "hyvää", "metsän", "järven"], ["house", "books", "good", "morning", "forest", "the"]
    rows = [(i, " ".join(r.choices(english, k=60)), "en") for i in range(60)] + [(100 + i, " ".join(r.choices(finnish, k=2000)), "fi") for i in range(60)]
    got = cross_parsing.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(g.lang_pred == ("fi" if g.doc_id >= 100 else "en") for g in got)


# --- toxicity -------------------------------------------------------------------------


def plain_score(text, model):
    """Noisy-or over sentences found character by character."""
    known, weights, bias = model
    index = {int(h): float(w) for h, w in zip(known, weights)}
    hashes = toxic_sentences.Bags().words

    def wide(c):
        return bool(toxic_sentences._within(np.array([ord(c)]), toxic_sentences.UNSPACED)[0]) if ord(c) > 127 else False

    def letter(c):
        if ord(c) < 128:
            return c.isalnum()
        return ord(c) not in toxic_sentences.WIDE_STOPS and not toxic_sentences._within(np.array([ord(c)]), toxic_sentences.SIGNS)[0]

    sentences, words = [], []
    for c in text + "\n":
        if c in "\n!.?" or (ord(c) > 127 and ord(c) in toxic_sentences.WIDE_STOPS):
            sentences.append(words)
            words = []
        else:
            words.append(c)
    score = 1.0
    for s in sentences:
        found, word = [], ""
        for i, c in enumerate(s + [" "]):
            if letter(c) and not wide(c):
                word += c
                continue
            if word:
                found.append(word)
            word = ""
            for k in range(1, toxic_sentences.GRAMS + 1):
                if i + k <= len(s) and all(wide(x) and letter(x) for x in s[i : i + k]):
                    found.append("".join(s[i : i + k]))
        if found:
            total = bias + sum(index.get(int(hashes.of(w)[0]), 0.0) for w in found)
            score *= 1 - 1 / (1 + math.exp(-max(-40, min(40, total))))
    return 1 - score


def toxic_corpus(kind):
    r = random.Random(7)
    clean = {"han": "今天天气很好我们去公园散步看见许多花草树木孩子在玩", "latin": "the sun is warm and we walk in the park with trees".split()}[kind]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        if kind == "han":
            parts = ["".join(r.choices(clean, k=14)) for _ in range(4)]
            parts[1] += "你是坏蛋" if toxic else ""
            rows.append((i, "。".join(parts) + "，"))
        else:
            parts = [" ".join(r.choices(clean, k=9)) for _ in range(4)]
            parts[2] += " vile scum" if toxic else ""
            rows.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_equals_a_plain_noisy_or_in_every_script(spark):
    for kind in ("han", "latin"):
        rows, labels = toxic_corpus(kind)
        docs = spark.createDataFrame(rows, "key long, text string")
        told = spark.createDataFrame(labels, "key long, toxic int").where(toxic_sentences.remainder("key", 3) != 1)
        model = toxic_sentences.train(docs, told)
        got = toxic_sentences.scored(docs, model, spots=True).collect()
        for g in got:
            assert math.isclose(g.score, plain_score(rows[g.key][1], model), abs_tol=1e-9)
            assert (g.score >= toxic_sentences.THRESHOLD) == bool(labels[g.key][1])
        spans = [(rows[g.key][1], s) for g in got if labels[g.key][1] for s in g.spots]
        assert spans and all(("坏蛋" if kind == "han" else "scum") in text[s.start : s.end] for text, s in spans)


def test_mixed_scripts_and_stops():
    bags = toxic_sentences.Bags()
    for text in ("Ärger? Nein! 你好世界。ok", "سلام؟ نعم", "ไทย abc ไทย", "日本", "。。", "é", "a…b", ""):
        bag = bags.of(text.encode())
        assert len(bag.begins) == (bag.sentence.max() + 1 if len(bag.sentence) else 0) and (bag.begins < bag.ends).all()
    assert len(bags.of("你好世界".encode()).feature) == 4 + 3 + 2
    assert len(bags.of("سلام؟ نعم".encode()).begins) == 2


def test_one_row_of_an_id_is_learned_from(spark):
    rows, labels = toxic_corpus("latin")
    docs = spark.createDataFrame(rows + [(0, "vile " * 50)] * 30 + [(4, "x " * 300_000)], "key long, text string")
    model = toxic_sentences.train(docs, spark.createDataFrame(labels, "key long, toxic int"))
    assert model is not None and len(model[0]) > 0


# --- quality --------------------------------------------------------------------------


def plain_quality(rows):
    """Measures by the libraries, bands by sorting, the verdict as stated."""
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    pattern, ranks = fertility_rules.byte_vocabulary()
    import base64

    bytes_ = tiktoken.Encoding("b", pat_str=pattern, mergeable_ranks={base64.b64decode(a): b for a, b in ranks}, special_tokens={})
    measured = {}
    for i, text, lang in rows:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        ids = [p for w in words for p in library.encode(w)]
        if not ids:
            measured[i] = None
            continue
        chars = sum(map(len, words))
        many = np.unique(ids, return_counts=True)[1] / len(ids)
        entropy = float(-(many * np.log2(many)).sum() / np.log2(len(ids))) if len(ids) > 1 else 0.0
        measured[i] = (chars / len(ids), chars / sum(len(bytes_.encode_ordinary(" " + w)) for w in words), sum(map(library.is_byte, ids)) / len(ids), entropy)
    return measured


def russian(n, seed):
    r = random.Random(seed)
    stems = "слово книга дорога человек время работа вечер город письмо вопрос история который большой новый говорить ходить".split()
    return [" ".join(r.choice(stems) + r.choice(["", "а", "ы", "ом"]) for _ in range(r.randint(60, 120))) for _ in range(n)]


def quality_rows(n):
    r = random.Random(3)
    english = "the of and walk house tree people make good water morning garden letter quick never always between".split()
    texts = [(i, " ".join(r.choices(english, k=r.randint(60, 140))), "en") for i in range(200)]
    noise = [(900 + k, " ".join(f"q{(k + j * 7919) % 99991:x}#$zx{j * 31 % 17}" for j in range(1, 120)), "en") for k in range(3)]
    return texts + noise + [(1000 + i, t, "ru") for i, t in enumerate(russian(n, 4))] + [(5000, None, "en"), (5001, "", None), (5002, "short text", "en")]


def test_measures_bands_and_verdict_equal_a_plain_version(spark):
    rows = quality_rows(60)
    got = {r.doc_id: r for r in fertility_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    measured = plain_quality(rows)
    passed = {i for i, r in got.items() if not r.base_failed}
    script = {i: fertility_rules.main_script(t or "") for i, t, _ in rows}
    group = {i: lang or script[i] for i, _, lang in rows}

    def quartiles(ids, m):
        x = sorted(measured[i][m] for i in ids)
        at = lambda p: x[max(1, math.ceil(p * len(x))) - 1]
        return len(x), at(0.25), at(0.75)

    for i, text, _ in rows:
        r = got[i]
        if measured[i] is None:
            assert not r.kept and r.piece_chars is None
            continue
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip((r.piece_chars, r.byte_chars, r.fallback_share, r.entropy), measured[i]))
        kept = i in passed
        for m, name in enumerate(fertility_rules.MEASURES):
            if kept:
                n, low, high = quartiles([j for j in passed if group[j] == group[i]], m)
                k, a, b = quartiles([j for j in passed if script[j] == script[i]], m)
                _, c, d = quartiles(passed, m)
                prior = fertility_rules.PRIOR
                wide = (n * (high - low) + prior * ((k * (b - a) + prior * (d - c)) / (k + prior))) / (n + prior)
                room = max(fertility_rules.REACH * wide, fertility_rules.FLOOR[name])
                kept = low - room <= measured[i][m] <= high + room
        assert r.kept == kept
    assert not any(got[900 + k].kept for k in range(3))


def test_a_group_is_judged_alike_at_every_size(spark):
    for n in (2, 60, 140):
        got = fertility_rules.quality(spark.createDataFrame(quality_rows(n), "doc_id long, text string, lang string")).collect()
        assert sum(r.kept for r in got if 1000 <= r.doc_id < 5000) == n


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_stages_equal_plain_decisions(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id AS key", "toxic").where(toxic_sentences.remainder("key", 3) != 1)
    model = toxic_sentences.train(table.selectExpr("doc_id AS key", "text"), labels)
    kept = {r.doc_id for r in corpus_pipeline.keep_harmless(spark, table, sf).collect()}
    assert model is not None and kept == {i for i, t in docs.items() if plain_score(t or "", model) < toxic_sentences.THRESHOLD}
    assert 0 < len(kept) < len(docs)
    harmless = table.where(table.doc_id.isin(list(kept))).where("length(text) < 700")
    samples = cross_parsing.train(harmless.selectExpr("doc_id AS key", "text", "lang").where(toxic_sentences.remainder("key", 3) != 1))
    most, letters = cross_parsing.limits(samples), set("".join(samples.values())) - {" "}

    def in_line(text):
        plain = cross_parsing.plain(text) if cross_parsing.LETTER.search(text) else ""
        if not letters & set(plain):
            return False
        rates = [(plain_phrases(s, plain) - 1, limit * len(plain)) for s, limit in zip(samples.values(), most)]
        return any(n <= m + 2 * math.sqrt(m) for n, m in rates)

    spoken = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, harmless, sf).collect()}
    short = {r.doc_id for r in harmless.collect()}
    assert spoken == {i for i in short if in_line(docs[i] or "")} and spoken
