"""Inputs on which operators once did less than the whole job."""

import collections
import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import decontaminate, lexicon, pii, quality, queries, repeated
from quernstone.operators import similarity

DOCS = "doc_id long, text string, lang string, n_chars string, id string, node string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, "x", "y") for i, t in enumerate(texts)], DOCS)


def test_benchmark_rows_repeat_or_have_no_id(spark):
    passages = [" ".join(f"{c}{k}" for k in range(12)) for c in "pqr"]
    rows = [(1, passages[0]), (1, passages[0]), (1, passages[1]), (None, passages[2]), (None, passages[2])]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = [*(f"before {p} after" for p in passages), "nothing of it"]
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate.decontaminate(table(spark, texts), bench).collect()}
    assert got == {0: (12, 1, ["1"], True), 1: (12, 1, ["1"], True), 2: (12, 1, [None], True), 3: (0, 0, [], False)}


def test_near_duplicates_decides_by_row(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (2, b), (2, a + " end"), (None, c), (None, c), (5, d + " end"), (5, d), (None, d), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (2, b), (None, c), (5, d)], key=repr)


def test_lsh_membership_and_threshold_of_bands(spark):
    rows = [(d, h, 7 if h < 2 and d < 4 else 100 * min(d, 9) + h) for d in range(11) for h in range(4)]
    signature = spark.createDataFrame(rows, "doc_id long, hash_no int, min_hash long")
    classes = {r.doc_id: r.class_id for r in similarity.lsh_classes(signature).collect()}
    assert classes == {d: min(d, 9) for d in range(11)}
    pairs = similarity.lsh_pairs(signature, threshold=0.5, of_bands=True).collect()
    assert sorted(map(tuple, pairs)) == [(a, b, 2) for a in range(4) for b in range(a + 1, 4)]


def test_personal_data_far_from_its_first_writing():
    field = pii.Field().train([f"call +1 (98{i}) 555-24{i}5 or mail u{i}@h{i}.org 7 days" for i in range(9)])
    text = "call +1 (988) 555-2485 now." + " some words then 988-555-2485 once more" * 40 + " and 988 555 2485 too, not 988 555 2486"
    more = [text[a:b] for a, k, b in field.more_spans(text, pii.base_spans(text))]
    assert more == ["988-555-2485"] * 40 + ["988 555 2485"]
    text = "call +1 988 555 2485 now. some words then 988-555-2485 once more"
    assert [text[a:b] for a, _, b in field.more_spans(text, pii.base_spans(text))] == ["988-555-2485"]


def test_common_words_have_any_length(spark):
    own, other = ("longer words only stand here".replace("only", "solely").replace("here", "herein").replace("stand", "standing").split(), "wholly different tokens appear throughout".split())
    texts = [" ".join(own[k:] + own[:k]) for k in range(5)] * 8 + [" ".join(other)]
    got = {r.doc_id: r for r in quality.judge(table(spark, texts), min_words=5, min_reference_words=20).collect()}
    assert got[0].class_distance is not None and got[0].common_distance < 0.2 < 0.6 < got[40].common_distance


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_contraction_at_the_very_end(file):
    coder = lexicon.Encoder(queries.vocabulary(file))
    for text in ("it's", "it don't", "I'm", "he'd", "we're", "I'll", "it'", "x 's"):
        flat, _ = coder.encode([text], 2)
        assert flat.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids + [2], text


@pytest.mark.parametrize("bits", [8, 11, 14, 17])
def test_repeated_values_by_any_number_of_buckets(spark, bits):
    rnd = np.random.default_rng(bits)
    units = [rnd.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) for _ in range(5)]
    units[1][:50] = units[3][:50]
    units[2][:9] = units[2][9:18]
    sent = [repeated.blobs(u, u[::2], bits) for u in units]
    rows = spark.createDataFrame(pa.Table.from_batches(sent), repeated.BLOBS)
    for choose, want in ((False, np.concatenate([units[1][:50], units[2][:9]])), (True, np.concatenate([units[1][:50], units[2][:9]]))):
        bitmap = repeated.repeated_map(rows, choose, bits)
        found = repeated.passes(bitmap, np.concatenate(units))
        picked = np.isin(want, np.concatenate([u[::2] for u in units])) if choose else np.ones(len(want), bool)
        assert repeated.passes(bitmap, want[picked]).all()
        assert found.sum() <= 2 * 59 + 5


def test_jaccard_joins_components_that_share_a_list(spark):
    from quernstone.llm import jaccard

    rnd = random.Random(11)
    texts = []
    for _ in range(6):  # drifting chains: ends are not similar, and pivots see only some of the links
        words = [f"w{rnd.randint(0, 60)}" for _ in range(60)]
        for _ in range(14):
            texts.append(" ".join(words))
            words = list(words)
            words[rnd.randrange(60)] = f"e{rnd.randint(0, 10**6)}"
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(table(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_token_orc_has_stripes_indexes_and_bloom_filters(spark):
    from quernstone.llm.staging import fresh_dir
    from quernstone.llm.token_orc import read_token_orc, write_token_orc

    rnd, path = random.Random(3), fresh_dir(spark, "orc")
    docs = spark.createDataFrame([(3 * i, " ".join(f"{rnd.randint(0, 10**9)}" for _ in range(60))) for i in range(6000)], "doc_id long, text string")
    write_token_orc(docs.coalesce(1), path, queries.vocabulary("word_bpe_49k.json"), 2, stripe_bytes=200_000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stripes = 0
    for file in read_token_orc(spark, path).inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        here = list(reader.getStripes())
        kinds = [s.getKind().toString() for x in here for s in reader.rows().readStripeFooter(x).getStreamsList() if s.getColumn() == 1]
        assert kinds.count("BLOOM_FILTER_UTF8") == kinds.count("ROW_INDEX") == len(here)
        encodings = [reader.rows().readStripeFooter(x).getColumns(1).getKind().toString() for x in here]
        assert set(encodings) == {"DIRECT_V2"}  # integer run-length encoding
        stripes = max(stripes, len(here))
    assert stripes > 1
    # An absent id between two others is in no file's Bloom filter; a present one needs few row groups.
    def rows_read(key):
        found = read_token_orc(spark, path).where(f"doc_id = {key}")
        n = len(found.collect())
        scans = [p for p in _nodes(found._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan orc")]
        return n, scans[0].metrics().apply("numOutputRows").value()

    assert rows_read(3 * 2500)[0] == 1 and rows_read(3 * 2500)[1] <= 2000
    assert rows_read(3 * 2500 + 1) == (0, 0)


def _nodes(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    children = plan.children()
    return [plan, *(x for k in range(children.size()) for x in _nodes(children.apply(k)))]


def test_private_keys_are_masked_whole_and_overlaps_once(spark):
    from quernstone.llm import secret_ledger

    line = "MIIEpAIBAAKCAQEA" + "aB3/" * 12
    keys = [
        f"-----BEGIN RSA PRIVATE KEY-----\n{line}\n{line}\nshort==\n-----END RSA PRIVATE KEY-----",
        f"-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{line}\n-----END PRIVATE KEY-----",
        f"-----BEGIN EC PRIVATE KEY-----\\n{line}\\nab=\\n-----END EC PRIVATE KEY-----",
        f"-----BEGIN PRIVATE KEY-----\n{line}",
        "-----BEGIN PRIVATE KEY-----\nMIIE\n-----END PRIVATE KEY-----",
    ]
    texts = [f"é before {k} after it, plainly" for k in keys]
    texts += ["x token=" + "0a" * 20 + " y", None, "", "token=abcdef1 " * 2000]
    got = {r.doc_id: r.text for r in secret_ledger.redact(table(spark, texts)).collect()}
    for k in range(5):
        assert got[k] == "é before [SECRET] after it, plainly"
    assert got[5] == "x [SECRET] y"
    assert got[6] is None and got[7] == "" and got[8] == "[SECRET] " * 2000


def test_running_sums_over_many_blocks(spark):
    from pyspark.sql import functions as F

    from quernstone.llm.secret_ledger import running

    values = [list(range(n)) for n in (0, 1, 255, 256, 257, 1000)]
    rows = spark.createDataFrame([(v,) for v in values], "v array<bigint>").select("v", running(F.col("v"), lambda a, x: a + x).alias("s")).collect()
    assert [r.s for r in rows] == [np.cumsum(v).tolist() for v in values]


def test_copies_are_scanned_once(spark):
    from quernstone.llm import secret_ledger
    from quernstone.llm.staging import fresh_dir

    path, rules = fresh_dir(spark, "ledger"), len(secret_ledger.BASE_RULES + secret_ledger.MORE_RULES)
    docs = spark.createDataFrame([(1, "token=abcdefgh")] * 1000 + [(None, "token=abcdefgh"), (None, "b"), (1, "b")], "doc_id long, text string")
    found = secret_ledger.scan_versions(docs, path)
    assert found.count() == 1003 and spark.read.parquet(path).count() == 2 * rules
    assert secret_ledger.redact(docs).where("text = '[SECRET]'").count() == 1001


def _class_of(c):
    if c in " \t\n\x0b\x0c\r":
        return 1
    kind = unicodedata.category(c)
    return {"Ll": 0, "Lu": 2}.get(kind, {"N": 3, "P": 4, "S": 4}.get(kind[0], 5))


def test_divergence_against_brute_force(spark):
    rnd = random.Random(17)
    pools = {"en": "The of and Cat's runs. 12 over, HILL".split(), "ru": "и в Кот бежит, 7 — холм! не".split(), "zh": "日本 語 ，三 五。 山".split()}
    rows = []
    for lang, pool in pools.items():
        for _ in range(12):
            rows.append((len(rows), " ".join(rnd.choice(pool) + rnd.choice(["", "", "x" * rnd.randint(1, 3)]) for _ in range(rnd.randint(5, 40))), lang))
        rows.append((len(rows), " ".join(rnd.choice("#%$ 123 QQ \x01 ²½".split()) for _ in range(30)), lang))
    rows += [(len(rows), None, "en"), (len(rows) + 1, "of " * 30, None), (len(rows) + 2, "few words here", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    classes, words = {}, {}
    for d, text, lang in rows:
        text = text or ""
        classes[d] = [sum(_class_of(c) == k for c in text) for k in range(6)]
        words[d] = text.split()
    distinct = spark.createDataFrame([(w,) for w in {w for x in words.values() for w in x}], "w string")
    order = {r.w: r.h for r in distinct.selectExpr("w", "xxhash64(w) AS h").collect()}
    refs = {}
    for lang in ("en", "ru", "zh"):
        own = [d for d, _, other in rows if other == lang]
        every = collections.Counter(w for d in own for w in words[d])
        common = [w for w, _ in sorted(every.items(), key=lambda x: (-x[1], order[x[0]]))[: quality.N_COMMON]]
        top = [every[w] for w in common]
        refs[lang] = (np.sum([classes[d] for d in own], axis=0), common, np.array([*top, sum(every.values()) - sum(top)]))

    def distance(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        part = lambda x, m: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return max(0.0, (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2) ** 0.5

    got = {r.doc_id: r for r in quality.judge(docs, min_words=12, min_reference_words=100).collect()}
    measured = 0
    for d, _, lang in rows:
        w, r = words[d], got[d]
        places = collections.defaultdict(list)
        for k in range(len(w) - 4):
            places[tuple(w[k : k + 5])].append(k)
        again = {p for at in places.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        far = False
        if lang in refs and len(w) >= 12:
            ref_classes, common, ref_common = refs[lang]
            seen = [w.count(c) for c in common]
            a, b = distance(classes[d], ref_classes), distance([*seen, len(w) - sum(seen)], ref_common)
            assert abs(r.class_distance - a) < 1e-9 and abs(r.common_distance - b) < 1e-9
            far, measured = a > 0.26 or b > 0.40, measured + 1
        else:
            assert r.class_distance is None and r.common_distance is None
        assert (r.base_failed, r.kept) == (failed, not failed and not far)
    assert measured > 20


def _plain_spans(text):
    """The base patterns as the contract words them, tried from every place; only for texts without long digit runs."""
    out = []
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, rule in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]) + sum(int(c) for c in digits[-1::-2])
            good = (True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(digits) <= 19 and double % 10 == 0, 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_personal_data_columns_against_brute_force(spark):
    rnd = random.Random(23)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "1.2.3.4", "999.1.1.1", "a.b@c.d", "@", "+", "é", " ", "  ", "\n", "7", "255", ".", "-", "x", "(", "+44 20 7946 0958", "日本", "u%@h-1.org.", "00001.002.3.0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + [None, "", "0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1", "1.2.3.4 " * 20_000]
    got = {r.doc_id: r for r in pii.find_personal_data(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        if d == 402:
            want = [(0, 1, 5006)]
        elif d == 403:
            want = []
        else:
            want = _plain_spans(text or "")
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)], text
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_field_finds_what_the_patterns_miss(spark):
    """Data whose digits other digits touch, in documents without base spans of that kind; decoys are left alone."""
    rnd = random.Random(31)
    phone = lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(0, 9999):04d}"
    texts = [f"word words {phone()} and more, version 2.{i % 9}" for i in range(150)] + [f"plain {rnd.randint(10**15, 10**16 - 1)} 10.0.{i}.7 text" for i in range(150)]
    planted = phone()
    texts += [f"here it stands {planted} 190.137.223.204 in one row", "under version 2.0 or 1234 and 3."]
    got = {r.doc_id: r for r in pii.find_personal_data(table(spark, texts)).collect()}
    spans = [texts[300][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[300].spans.split(",")) if k == "phone"]
    assert got[300].n_phone == 0 and spans == [planted]
    assert got[301].spans == ""
