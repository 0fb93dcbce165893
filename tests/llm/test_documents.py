"""Decontamination, Jaccard join, language, token files, resampling and the pipeline against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from llm_support import CLASHING, DOCS, TESTDATA, ordered, small_documents, texts  # noqa: F401
from tenorline.llm import decontaminate, importance, jaccard, language, mixing, token_files
from tenorline.llm.grams import grams, text_bytes, tokens
from tenorline.llm.workload import tokenizer_path

BENCH = {"item_id": pa.int64(), "text": pa.string()}
VOCABULARY = ["stone", "river", "éclair", "walks", "under", "seven", "große", "yellow", "lamp", "night", "paper", "quiet", "bread", "tower", "glass", "winter", "market", "honest", "cloud", "iron"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 30)) for _ in range(n))


# --- decontamination


def simple(text: str | None) -> str:
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def fewest_edits(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(text: str, edits: int, seed: int) -> str:
    rng, out = random.Random(seed), list(text)
    for place in sorted(rng.sample(range(len(out)), edits), reverse=True):
        out[place:place + 1] = rng.choice([[], ["q"], [out[place], "z"]])
    return "".join(out)


def test_leaks_equal_full_alignment(texts, tmp_path):
    items = [{"item_id": i, "text": prose(i, 12 + i)} for i in range(6)] + [{"item_id": None, "text": prose(77, 15)}, {"item_id": 90, "text": None}, {"item_id": 91, "text": "short"}, {"item_id": 92, "text": ""}]
    rows = [{"doc_id": None, "text": None}, {"doc_id": 1, "text": ""}, {"doc_id": 2, "text": prose(900, 60000)}, {"doc_id": 3, "text": "short"}]
    for i, item in enumerate(items[:7]):
        for edits in (0, 2, 4, 6, 8, 11):
            rows.append({"doc_id": 100 * i + edits + 10, "text": prose(500 + i, 20) + ". " + edited(item["text"], edits, i) + "! " + prose(600 + i, 20)})
        rows.append({"doc_id": 100 * i + 50, "text": items[i]["text"].upper().replace(" ", " -- ")})
        rows.append({"doc_id": 100 * i + 51, "text": items[i]["text"][:len(items[i]["text"]) // 2]})
    rows += rows[-2:]
    docs = texts(tmp_path, rows, CLASHING, 3)
    want = set()
    for r in rows:
        for item in items:
            m = len(simple(item["text"]).encode())
            if m >= decontaminate.Q and len(r["text"] or "") < 5000 and fewest_edits(simple(item["text"]), simple(r["text"])) <= decontaminate.budget(m) - 1:
                want.add((r["doc_id"], item["item_id"]))
    found = ordered(decontaminate.find_leaks(docs, texts(tmp_path, items, BENCH)))
    got = {(r["doc_id"], r["item_id"]) for r in found}
    for r in rows:  # at the last edit, bytes and characters may count differently; there either answer is right
        for item in items:
            if (r["doc_id"], item["item_id"]) in got - want:
                assert fewest_edits(simple(item["text"]), simple(r["text"])) <= decontaminate.budget(len(simple(item["text"]).encode()))
    assert want <= got and len(want) > 20
    exact = next(r for r in found if r["doc_id"] == 110)
    assert simple(next(r["text"] for r in rows if r["doc_id"] == 110)[exact["start"]:exact["stop"]]) == simple(items[1]["text"])
    blocks = ordered(decontaminate.with_leaks(docs.select("doc_id", "text"), texts(tmp_path, items, BENCH), block_chars=300).selectExpr("doc_id", "explode(leaks) l").select("doc_id", "l.*"))
    assert blocks == found
    kept = decontaminate.clean_documents(docs, texts(tmp_path, items, BENCH))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["doc_id"] not in {d for d, _ in got})


def test_leaks_behind_typography_and_in_other_scripts(texts, tmp_path):
    plain = 'the captain said "go on" and then - with a sigh - he left the old harbour behind for good, so "that" was it'
    others = ["\u0434\u043e\u0436\u0434\u044c \u0438\u0434\u0451\u0442 \u0432\u0435\u0441\u044c \u0434\u0435\u043d\u044c \u0438 \u0440\u0435\u043a\u0430 \u0440\u0430\u0441\u0442\u0451\u0442", "\u4eca\u65e5\u306f\u3068\u3066\u3082\u3044\u3044\u5929\u6c17\u3067\u3059\u306d\u3001\u6563\u6b69\u306b\u884c\u304d\u307e\u3057\u3087\u3046"]
    items = [{"item_id": 1, "text": plain}] + [{"item_id": 2 + i, "text": t} for i, t in enumerate(others)] + [{"item_id": 9, "text": "What is 2+2?"}, {"item_id": 10, "text": "?!"}]
    curly = plain.replace(' "', " \u201c").replace('"', "\u201d").replace("-", "\u2014")
    rows = [{"doc_id": 1, "text": "x. " + curly + " y"}, {"doc_id": 2, "text": plain.replace(" ", "\u00a0")}, {"doc_id": 3, "text": plain.replace(", ", "\u2026 ")}]
    rows += [{"doc_id": 4, "text": "\u00ab" + others[0].upper() + "\u00bb"}, {"doc_id": 5, "text": "\u300c" + others[1] + "\u300d"}, {"doc_id": 6, "text": "so, what is 2 + 2? four"}, {"doc_id": 7, "text": "somewhat is 2 + 2 ?! and what is 2 + 22"}, {"doc_id": 8, "text": "what is 2 2"}]
    found = ordered(decontaminate.find_leaks(texts(tmp_path, rows, DOCS, 2), texts(tmp_path, items, BENCH)))
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == {(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 2, 0), (5, 3, 0), (6, 9, 0), (8, 9, 0)}
    one = next(r for r in found if r["doc_id"] == 6)
    assert rows[5]["text"][one["start"]:one["stop"]] == "what is 2 + 2"


def test_many_items_with_one_opening_phrase_stay_in_bounds(monkeypatch):
    """Postings are counted in pieces; pieces of any size give the same bands."""
    opening = "question and answer about " * 4
    items = decontaminate.Items([(i, opening + prose(i, 12)) for i in range(60)])
    data, _, _ = decontaminate.normalized(pa.array([opening * 20 + prose(3, 12) + " " + opening + prose(4, 12)]))
    whole = set(zip(*(x.tolist() for x in items.bands(data))))
    monkeypatch.setattr(decontaminate, "POSTINGS", 50)
    assert set(zip(*(x.tolist() for x in items.bands(data)))) == whole and {3, 4} <= {i for i, _ in whole}


def test_leaks_of_nothing(texts, tmp_path):
    empty = texts(tmp_path, [], DOCS)
    assert ordered(decontaminate.find_leaks(empty, texts(tmp_path, [{"item_id": 1, "text": prose(1, 20)}], BENCH))) == []
    assert ordered(decontaminate.find_leaks(texts(tmp_path, [{"doc_id": 1, "text": "a b"}], DOCS), texts(tmp_path, [], BENCH))) == []


# --- Jaccard join


def shingles(text: str | None) -> set:
    words = [w for w in re.split(r"[^0-9a-z_\x80-\U0010ffff]+", (text or "").lower()) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows: list[dict], threshold: float = 0.8) -> list[tuple]:
    sets = [shingles(r["text"]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)].append(r["doc_id"])
    own = [r["doc_id"] if not sets[i] else min(least[find(i)], default=None) for i, r in enumerate(rows)]
    return sorted(((r["doc_id"], c, n) for r, c, n in zip(rows, own, links)), key=str)


def near_rows() -> list[dict]:
    rows = [{"doc_id": i, "text": prose(i, 40 + i % 50)} for i in range(60)]
    for k in range(4):  # chains of small changes, around the threshold and over it
        words = prose(1000 + k, 120).split()
        for step in range(12):
            rows.append({"doc_id": 200 + 20 * k + step, "text": " ".join(words)})
            words[(step * 9 + k) % len(words)] = f"changed{k}{step}"
    rows += [{"doc_id": 400 + i, "text": prose(5, 45)} for i in range(5)] + [{"doc_id": 5, "text": prose(5, 45)}, {"doc_id": None, "text": prose(5, 45)}, {"doc_id": None, "text": prose(5000, 9)}]
    rows += [{"doc_id": 500, "text": None}, {"doc_id": 501, "text": ""}, {"doc_id": 502, "text": " ... "}, {"doc_id": 503, "text": "two words"}, {"doc_id": 504, "text": "Two, words!"}, {"doc_id": 505, "text": "two words three"},
             {"doc_id": 506, "text": prose(8, 30000)}, {"doc_id": 507, "text": prose(8, 30000) + " end"}]
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_classes_and_links_equal_brute_force(texts, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_rows()
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ordered(jaccard.jaccard_join(texts(tmp_path, rows, CLASHING, 4)))), key=str)
    assert got == plain_classes(rows)


def test_one_of_each_class_stays(texts, tmp_path):
    rows = near_rows()
    docs = texts(tmp_path, rows, CLASHING, 2)
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    want = {(d, c) for d, c, _ in plain_classes(rows) if d == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(d for d, _ in want if d is not None) and got.count(None) == 1


def test_no_rows_have_no_classes(texts, tmp_path):
    assert ordered(jaccard.jaccard_join(texts(tmp_path, [], DOCS))) == []
    assert ordered(jaccard.one_per_class(texts(tmp_path, [], DOCS))) == []


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches()
    rng = np.random.default_rng(1)
    equal = rng.random((200_000, 96)) < 0.8
    dropped = np.zeros(len(equal), bool)
    for n, m in least.items():
        dropped |= equal[:, :n].sum(axis=1) < m
    assert dropped.mean() < 1e-4 and least[96] > 48


def test_grams_equal_plain_words():
    column = pa.array(["a b c d e f", None, "", "x", "one  two,three\nfour", "a b c d e f"])
    hashed, counts = tokens(*text_bytes(column))
    assert counts.tolist() == [6, 0, 0, 1, 4, 6]
    runs, sizes = grams(hashed, counts, 5)
    assert sizes.tolist() == [2, 0, 0, 1, 1, 2] and runs[:2].tolist() == runs[-2:].tolist() and len(set(runs.tolist())) == 4


# --- language


def test_language_of_unseen_documents(texts, tmp_path, small_documents):
    rows = pq.read_table(TESTDATA / "sf0.01/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in language.identify(texts(tmp_path, rows, CLASHING, 4)).collect()}
    assert len(got) == len(rows)
    fresh = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]].held_out == (r in fresh) for r in rows) and all(0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[r["doc_id"]].lang_pred == r["lang"] for r in fresh]) > 0.97


def test_language_edges(texts, tmp_path):
    train = [{"doc_id": i, "text": t, "lang": lang} for i in range(1, 60) for t, lang in (("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"))]
    rows = train + [{"doc_id": None, "text": None, "lang": "xx"}, {"doc_id": None, "text": "les tables", "lang": "yy"}, {"doc_id": 5, "text": "12 34 !", "lang": None}, {"doc_id": 6, "text": "cats", "lang": None}, {"doc_id": 7, "text": "THE MAT " * 50000}, {"doc_id": 8, "text": "日本"}]
    got = language.identify(texts(tmp_path, rows, CLASHING, 2)).collect()
    tail = {(r.doc_id, r.lang_pred) for r in got} - {(r["doc_id"], r["lang"]) for r in train}
    assert len(got) == len(rows) and {(None, "und"), (None, "fr"), (5, "und")} <= tail | {(r.doc_id, r.lang_pred) for r in got}
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"} and (6, "en") in {(r.doc_id, r.lang_pred) for r in got}
    assert {r.lang_pred for r in language.identify(texts(tmp_path, [{"doc_id": 1, "text": "abc"}], DOCS)).collect()} == {"und"}
    assert language.identify(texts(tmp_path, [], DOCS)).collect() == []


# --- token files


def test_token_files_round_trip(texts, tmp_path, small_documents, spark):
    rows = small_documents + [{"doc_id": None, "text": "null id"}, {"doc_id": 3, "text": None}, {"doc_id": 3, "text": ""}, {"doc_id": 3, "text": "x"}, {"doc_id": 3, "text": "x"}, {"doc_id": -5, "text": "a <|endoftext|> b"}, {"doc_id": 10**6, "text": "ab  c\n d's" * 30000}]
    docs, path = texts(tmp_path, rows, CLASHING, 3), str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, tokenizer_path())
    plain = token_files.Encoder(tokenizer_path()).tokenizer
    files = token_files.read_tokens(spark, path)
    stored = sorted(files.collect(), key=lambda r: (r.shard, r.begin))
    want = Counter((r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in stored) == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in stored]
    assert order == sorted(order)
    digests = sorted(token_files.token_digests(files).collect(), key=lambda r: (r.start, r.n_tokens))
    at = 0
    for r, d in zip(stored, digests):
        assert (d.doc_id, d.start, d.n_tokens) == (r.doc_id, at, len(r.ids)) and d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    meta = pq.ParquetFile(next((tmp_path / "tokens").glob("part-*.parquet"))).metadata.row_group(0).column(4)
    assert meta.has_offset_index and meta.has_column_index is not None and {"PLAIN_DICTIONARY", "RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(meta.encodings)


def test_pieces_give_the_ids_of_the_whole_text():
    encoder, rng = token_files.Encoder(tokenizer_path()), random.Random(5)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "b", "'s", "'", "É", "ñ", "1", "23", "!", "?!", "x", "the", "日本", "🙂", "<|endoftext|>", "́", "\x1c", "\u0085", "_", "-"]
    parts += [".", ",", ".\n", "\n\n", "|", "%%", "²", "Ⅷ", "ß", "ƒ", "×", "Ж", "T", " T", "'ll", "\u200b", "\u00a0"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    plain = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(many, add_special_tokens=False)]
    assert [t for t, a, b in zip(many, encoder.encode(many), plain) if a != b] == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_gives_the_ids_of_the_whole_text(name):
    """A vocabulary that normalizes and splits in its own way gets whole texts."""
    encoder = token_files.Encoder(tokenizer_path().replace("byte_bpe_50k.json", name))
    assert encoder.in_pieces == (name == "byte_bpe_50k.json")
    many = [prose(i, 30) + "\n\n\u00c9t\u00e9 It's 12 a.m., <|endoftext|>\tCAF\u00c9!\nb" for i in range(20)] + [""]
    plain = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(many, add_special_tokens=False)]
    assert encoder.encode(many) == plain


def test_texts_are_cut_where_the_tokenizer_cuts():
    many = ["Don't stop,  \n\n\u00c9t\u00e9s\u00d72: 12a", "  ", " x", "\u043f\u0440 \u0438\u0432\n\u65e5", "a \u00a0b c", "one two"]
    want = [["Don", "'t", " stop", ",", "  \n", "\n", "\u00c9t\u00e9s\u00d72", ":", " 12", "a"], ["  "], [" x"], ["\u043f\u0440", " \u0438\u0432", "\n", "\u65e5"], ["a", " \u00a0b", " c"], ["one two"]]
    data, at = text_bytes(pa.array(many), lower=False)
    begin = token_files.cuts(data, at, np.array([t == "one two" for t in many]))
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, begin[1:])] == [p for pieces in want for p in pieces]
    encoder = token_files.Encoder(tokenizer_path())
    for text, pieces in zip(many, want):
        assert [i for p in pieces for i in encoder.tokenizer.encode(p, add_special_tokens=False).ids] == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_remembered_without_the_marks_around_them():
    """A word has its ids from the model once, whatever stands beside it; nothing of it goes through the splitting again."""
    encoder, given, asked = token_files.Encoder(tokenizer_path()), [], []
    whole, single = encoder.whole, encoder.single
    encoder.whole = lambda texts: given.extend(texts) or whole(texts)
    encoder.single = lambda piece: asked.append(piece) or single(piece)
    many = [f"{a} \u00e9queauxre{b} word{c} \u00e9queauxre" for a in ("-", "1") for b in ("%%%", ", ", ".\n") for c in ("&&", "#", "12", "")]
    plain = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(many, add_special_tokens=False)]
    assert encoder.encode(many) == plain == encoder.encode(many)
    assert given == [] and len(asked) == len(set(asked)) == len(encoder.known) and {" \u00e9queauxre", "%%%", "12"} <= set(asked)


def test_ids_of_nulls_and_of_part_of_a_column():
    encoder = token_files.Encoder(tokenizer_path())
    ids, sizes = encoder.ids(pa.array(["left out", None, "", "a <|endoftext|> b", None, "c" * 100, "left out"]).slice(1, 5))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in ("", "", "a <|endoftext|> b", "", "c" * 100)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert not any(len(p) > token_files.PIECE_BYTES for p in encoder.known) and encoder.encode([]) == []


def test_no_tokens(texts, tmp_path):
    assert ordered(token_files.encode_and_read(texts(tmp_path, [], DOCS), tokenizer_path())) == []


# --- resampling

LABELS = {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()}


def test_resampling_rejects_what_is_labelled_bad(texts, tmp_path):
    rows = pq.read_table(TESTDATA / "sf0.01/documents.parquet").to_pylist()
    labels = pq.read_table(TESTDATA / "sf0.01/labels.parquet").to_pylist()
    extra = [{"doc_id": None, "text": None}, {"doc_id": -1, "text": ""}, {"doc_id": -2, "text": "the of " * 40000}, rows[0]]
    marks = labels + [{"doc_id": None, "quality": 0}, {"doc_id": 0, "quality": None}, {"doc_id": 10**9, "quality": 1}]
    docs = texts(tmp_path, rows + extra, CLASHING, 3)
    got = importance.classify_quality(docs, texts(tmp_path, marks, LABELS)).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == len(rows) + len(extra) and np.mean([(r["doc_id"] in kept) == (r["quality"] == 1) for r in labels]) > 0.97
    assert all(r["doc_id"] in kept for r in labels if r["quality"] == 1 and r["toxic"] == 0)
    good = importance.good_documents(docs, texts(tmp_path, marks, LABELS))
    assert good.columns == docs.columns and Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in got if r.kept)
    keys = sorted((r.sample_key for r in got), reverse=True)
    assert min(r.sample_key for r in got if r.kept) == pytest.approx(keys[sum(r.kept for r in got) - 1])


def test_resampling_without_labels_keeps_all(texts, tmp_path):
    docs = texts(tmp_path, [{"doc_id": 1, "text": "a"}, {"doc_id": 2, "text": None}], DOCS)
    assert all(r.kept for r in importance.classify_quality(docs, texts(tmp_path, [], LABELS)).collect())
    assert importance.classify_quality(texts(tmp_path, [], DOCS), texts(tmp_path, [{"doc_id": 1, "quality": 1}], LABELS)).collect() == []


def test_kth_largest_equals_sorting(spark):
    values = [random.Random(i).randrange(1 << 60) for i in range(300)] + [0, (1 << 60) - 1, 5, 5, 5]
    keys = spark.createDataFrame([(v,) for v in values], "digits long")
    for k in (1, 2, 150, 301, len(values)):
        assert importance.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


# --- pipeline


def test_pipeline_equals_its_stages_in_plain_python(spark):
    sf = str(TESTDATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = {r.doc_id for r in importance.classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    docs = [d.asDict() for d in docs if d.doc_id in kept]
    firsts = {d for d, c, _ in plain_classes(docs) if d == c}
    items = [simple(r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    docs = [d for d in docs if d["doc_id"] in firsts and not any(i in simple(d["text"]) for i in items)]
    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= set(sizes)
    assert max(Counter(r.doc_id for r in got).values()) <= 3 and sum(sizes[r.doc_id] for r in got) == pytest.approx(sum(sizes.values()), rel=0.1)  # few documents a source here
    plain = token_files.Encoder(tokenizer_path()).tokenizer
    own = {d["doc_id"]: plain.encode(d["text"], add_special_tokens=False).ids + [2] for d in docs}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own[r.doc_id]), zlib.crc32(np.array(own[r.doc_id], "<u4").tobytes()))
        at += r.n_tokens
    assert [n for n, _ in corpus_pipeline.STAGES] and mixing
