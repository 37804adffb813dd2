"""The training-data operators against brute force and SQL, with awkward inputs."""

import hashlib
import io
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest

from quernstone.llm import codepoints, decontaminate, jaccard, lexicon, packing, pii, quality, queries, secret_ledger, warc
from quernstone.llm.block_anchors import deduplicate
from quernstone.llm.fst_counts import TokenCounter, count_tokens
from quernstone.llm.staging import fresh_dir
from quernstone.llm.token_orc import token_digests, write_token_orc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
ODD = ["", " ", "a", "'s's don't 'sout I'll", "'re'", "a\n\nb \n c  ", "<|endoftext|> hi<|startoftext|>x", "İstanbul ΣΑΣ ς", "éa", "x　y", "日本語 テスト", "''s", "x 're", "\x00a\x00", "👍🏽 ok", "it's\n's", "1234 12.5"]
DOCS = "doc_id long, text string, lang string, n_chars string, id string, node string"


def table(spark, texts):
    """Documents with nulls, repeated rows and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 2 else None, None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [None, *ODD, ODD[3], "word " * 3000])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_sql):
    columns = {"op9_divergence_rules": None}
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name]) if name not in columns else None


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(file):
    coder, rnd = lexicon.Encoder(queries.vocabulary(file)), random.Random(7)
    texts = ODD + ["".join(rnd.choice("'  \n\tstmdrevlaé1².!AΣİ́ x<|>") for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    flat, n = coder.encode(texts, 2)
    want = [e.ids + [2] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want))
    assert flat.tolist() == [x for w in want for x in w]


def test_piece_table_is_bounded():
    coder = lexicon.Encoder(queries.vocabulary("word_bpe_49k.json"))
    coder.table.most = 50
    texts = [f"word{i} other{i} " * 3 for i in range(200)]
    for t in texts:
        flat, _ = coder.encode([t], 2)
        assert flat.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids + [2]


def test_transducer_counts(spark, odd, empty):
    machine = TokenCounter(queries.vocabulary("word_bpe_49k.json"))
    machine.words.most = 200
    texts = ODD + ["x" * 70_000]
    for _ in range(2):
        assert machine.count(texts).tolist() == [len(e.ids) for e in machine.coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    rows = count_tokens(odd, queries.vocabulary("word_bpe_49k.json")).collect()
    assert len(rows) == odd.count() and rows[0].n_tokens == 0 and rows[-1].over_limit
    assert count_tokens(empty, queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_token_orc(spark, odd, empty):
    coder, path = lexicon.Encoder(queries.vocabulary("word_bpe_49k.json")), fresh_dir(spark, "t")
    write_token_orc(odd, path, queries.vocabulary("word_bpe_49k.json"), 2)
    before = 0
    for row, text in zip(token_digests(spark, path).orderBy("doc_id").collect(), [r.text for r in odd.orderBy("doc_id").collect()], strict=True):
        ids = coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (before, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        before += len(ids)
    path = fresh_dir(spark, "t")
    write_token_orc(empty, path, queries.vocabulary("word_bpe_49k.json"), 2)
    assert token_digests(spark, path).count() == 0


def test_packing(spark, odd, empty):
    rows = packing.pack_documents(odd, queries.vocabulary("byte_bpe_50k.json"), 0, size=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    coder = lexicon.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    for row in odd.collect():
        ids, at = coder.tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0], 0
        for k, p in enumerate(sorted(by_doc[row.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == 64)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert packing.pack_documents(empty, queries.vocabulary("byte_bpe_50k.json"), 0).count() == 0


def test_open_bins_are_best_fit():
    rnd, bins, free = random.Random(3), packing.OpenBins(20, 5), {}
    for _ in range(2000):
        n = rnd.randint(1, 20)
        best = min((f for f in free.values() if f >= n), default=20)
        number, place = bins.put(n)
        assert place == 20 - best
        free[number] = best - n
        if not free[number]:
            del free[number]
        if len(free) > 5:
            tightest = min(free.values())
            closed = bins.last_closed
            assert free.pop(closed) == tightest
        assert bins.still_open() == free


def test_warc_ranges(spark):
    records = [warc.page_record(i, None if i % 5 == 0 else f"http://h/{i}", (b"\x1f\x8b\x08" * 40 + b"p" * i) if i % 3 else b"", None, "2024-01-01T00:00:00Z") for i in range(120)]
    inner = warc.page_record(999, "http://inner", b"inside" * 50, None, "2024-01-01T00:00:00Z")
    deflate = zlib.compressobj(0, wbits=31)  # stored: the inner member's bytes stand in the archive as they are
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    records.insert(60, deflate.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:500>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + deflate.flush())
    whole = b"".join(records)
    for step in (1, 7, 100, 5000, len(whole)):
        got = [warc._page(warc.parse(r)[0]["warc-record-id"]) for s in range(0, len(whole), step) for r in warc.members(io.BytesIO(whole), len(whole), s, min(len(whole), s + step), block=64)]
        assert got == [*range(60), 500, *range(60, 120)]


def test_warc_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (3, "v", None), (4, "w", ""), (None, "x", "same"), (2, None, "same")], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(pages, fresh_dir(spark, "w")), split_bytes=50).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "revisit", 2)], key=repr)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), fresh_dir(spark, "w"))).count() == 0


def near_copies():
    rnd = random.Random(5)
    base = [rnd.choice(WORDS) + str(rnd.randint(0, 400)) for _ in range(120)]
    texts = [None, "", "one two", "ONE two", " ".join(base), " ".join(base), " ".join(base).upper()]
    for _ in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = f"edit{rnd.randint(0, 9999)}"
        texts.append("\t".join(copy))
    license_line = "this passage is shared by very many different documents of the collection " * 2
    texts += [license_line + " ".join(f"own{i}x{k}" for k in range(30)) for i in range(30)]
    return texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard(spark, empty):
    texts = near_copies()
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in jaccard.similar_components(table(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard.similar_components(empty).count() == 0


def test_block_anchors(spark, empty):
    texts = [*near_copies(), "same " * 80, "é " * 40]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, p) for at in seen.values() if len(at) > 1 for i, k in at for p in range(k, k + 35)}
    for r in deduplicate(table(spark, texts), keep_text=True).collect():
        kept = " ".join(w for p, w in enumerate(words[r.doc_id]) if (r.doc_id, p) not in gone)
        assert (r.n_words, r.kept, r.kept_sha256) == (len(words[r.doc_id]), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert deduplicate(empty).count() == 0


def test_personal_data(spark, odd, empty):
    text = "mail a@b@c.d.e x.y@z.org, 1.2.3.4.5.6.7.8 999.1.1.1 card 4111 1111 1111 1111 +1 (988) 555-2485 and later 988-555-2485 or 5550000"
    spans = pii.base_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [("email", "b@c.d.e"), ("email", "x.y@z.org"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]
    field = pii.Field().train([f"call +1 (98{i}) 555-24{i}5 or mail u{i}@h{i}.org 7 days" for i in range(9)])
    again = "call +1 (988) 555-2485 now. some words then 988-555-2485 once more, not 1234567 nor 2.0."
    more = field.more_spans(again, pii.base_spans(again))
    assert all(again[a:b] == "988-555-2485" for a, _, b in more)
    clean = "version 2.0 of 1234567 and 12345678901234567"
    assert field.more_spans(clean, pii.base_spans(clean)) == []
    assert pii.find_personal_data(odd).count() == odd.count()
    assert pii.find_personal_data(empty).count() == 0


def test_ledger_scans_only_what_is_new(spark, empty):
    path = fresh_dir(spark, "ledger")
    texts = ["token = 'abcdef1'", "token = 'abcdef1'", None, "x AKIA" + "Z9" * 10, "secret:token:abcdef é " + "ab" * 13, "﷐password=abc password=abcdefg﷑"]
    docs = table(spark, texts)
    first = {r.doc_id: [(s.kind, s.begin, s.finish) for s in r.findings] for r in secret_ledger.scan_versions(docs, path).collect()}
    assert first == {0: [("assign", 0, 16)], 1: [("assign", 0, 16)], 2: [], 3: [("access", 2, 26)], 4: [("hex", 22, 48)], 5: [("assign", 14, 30)]}
    n = spark.read.parquet(path).count()
    rules = len(secret_ledger.BASE_RULES + secret_ledger.MORE_RULES)
    assert n == 5 * rules
    assert {r.doc_id: [(s.kind, s.begin, s.finish) for s in r.findings] for r in secret_ledger.scan_versions(docs, path).collect()} == first
    assert spark.read.parquet(path).count() == n
    secret_ledger.scan_versions(table(spark, [*texts, "new"]), path).count()
    assert spark.read.parquet(path).count() == n + rules
    clean = {r.doc_id: r.text for r in secret_ledger.redact(docs).collect()}
    assert clean[0] == "[SECRET]'" and clean[2] is None and "AKIA" not in clean[3] and clean[5] == "﷐password=abc [SECRET]﷑"
    assert secret_ledger.scan_versions(empty).count() == 0


def test_decontamination(spark, empty):
    passage = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(1, passage.upper()), (2, "tiny item"), (3, None), (4, "never seen words")], "item_id long, text string")
    texts = [f"before {passage} after", "a TINY, item", None, " ".join(f"w{k}" for k in range(9)), " ".join(f"w{k}" for k in range(12) if k != 5), f"w0 {passage}"]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.n_near_items) for r in decontaminate.decontaminate(table(spark, texts), bench).collect()}
    assert got[0] == (14, 12, ["1"], 0) and got[1] == (3, 2, ["2"], 0) and got[2][:3] == (0, 0, []) and got[3][1] == 0 and got[4][1] == 0 and got[5][1] == 12
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(table(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_quality(spark, odd, empty):
    texts = ["a b c d e f g h i j", "one two three four five " * 4, None, "x\nx\n\nx y z", "# $ % " * 5]
    for r in quality.judge(table(spark, texts)).collect():
        text = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        places = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {p for at in places.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
    assert quality.judge(odd).count() == odd.count()
    assert quality.judge(empty).count() == 0


def test_prefix_scan_composes_maps():
    rnd = np.random.default_rng(1)
    maps = rnd.integers(0, 6, (37, 6)).astype(np.uint8)
    from quernstone.llm.fst_counts import compose

    state, got = np.arange(6), compose(maps)
    for k in range(37):
        state = maps[k][state]
        assert (got[k] == state).all()


def test_class_table_has_the_classes():
    table = codepoints.class_table()
    for c in "aé日1²'! \n":
        kind = unicodedata.category(c)[0]
        assert table[ord(c)] == {"L": codepoints.LETTER, "N": codepoints.NUMBER}.get(kind, codepoints.SPACE if c.isspace() else codepoints.OTHER)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    clean = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(60)) for _ in range(6)]
    texts = [*clean, clean[0], "too short", "same words again and again " * 9, clean[1] + " " + " ".join(f"q{k}" for k in range(12)), clean[2] + " and " + clean[3] + " token = abcdefghij"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(f"q{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    final = {r.doc_id: r.text for r in kept.collect()}
    assert sorted(final) == [0, 1, 2, 3, 4, 5, 10]
    assert final[10].endswith("[SECRET]") and final[0] == clean[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(final)


def test_stages_take_any_columns(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(40)) for _ in range(3)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(7, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = docs.selectExpr("*", *(f"7 AS {c}" for c in ("content", "content_id", "findings", "document", "masked", "stays", "id", "found", "results", "items", "n_words", "kept", "short", "contaminated")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, str(tmp_path)), stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
