import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.llm import texts as text_pieces
from eventmill.llm import bpe, chat, exact_dedup, fingerprints, langid, minhash, packing, pii, quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, level string, key double"
LONG = "lorem ipsum dolor sit amet " * 9000


def _path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark, texts, langs=None):
    """Documents with extra columns whose names operators use inside."""
    rows = [(k, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), 7, "x", 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \t\n", "a b c", "abc", "A  B c", "x" * 9000, LONG, "é", "é", "a b c", "\U0001f600 ok", "😀"]


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("block,bits", [(4, 3), (4096, 128)])
def test_exact_dedup_matches_brute_force(spark, block, bits):
    texts = [t for t in ODD if t != LONG] + ["a" * 13, "a" * 12, "abcabcabca"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(_docs(spark, texts), block=block, bits=bits).collect()}
    normal = [("" if t is None else t).translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for t in texts]
    assert len(got) == len(texts)
    for k, n in enumerate(normal):
        group = [j for j, m in enumerate(normal) if m == n]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        r = got[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(group), keep == k, _sha(n))


def test_exact_dedup_repeated_rows_and_empty(spark):
    d = _docs(spark, ["a b", "ab"])
    twice = d.unionByName(d)
    assert exact_dedup.exact_dedup(twice).where("kept").count() == 1
    kept = exact_dedup.keep_first(twice)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [0]
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0


def _canon(t):
    n = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(n.split())


@pytest.mark.parametrize("bits", [2, 128])
def test_fingerprints_match_brute_force(spark, bits):
    texts = [t for t in ODD if t != LONG]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(_docs(spark, texts), bits=bits).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(_docs(spark, texts), bits=bits).collect()}
    n = len(texts)
    for k in range(n):
        t, after = texts[k] or "", texts[(k - 1) % n] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), _sha(edited), plain[k])
        assert r.near_edited == float(_canon(t) == _canon(edited)) and r.near_next == float(_canon(t) == _canon(after))
        assert (r.fingerprint == r.edited_fingerprint) == (_canon(t) == _canon(edited))
        for j in range(n):
            assert (plain[k] == plain[j]) == (_canon(texts[k]) == _canon(texts[j]))
    assert fingerprints.edited_fingerprints(_docs(spark, ["one"])).first().near_next == 1.0
    assert fingerprints.edited_fingerprints(_docs(spark, ["one"]).limit(0)).count() == 0


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(_path())
    rng = random.Random(1)
    letters = "ab c'sé²\x1c’中́ \n\t\r\x85\xa0 1!aa\U0001f600"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["x<|endoftext|> y"]
    got = {r.doc_id: r for r in bpe.encoded_documents(_docs(spark, texts), _path()).collect()}
    vocab = bpe.Vocabulary(_path())
    for k, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        back = tk.decode(ids, skip_special_tokens=False)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), _sha(",".join(map(str, ids))), _sha(back))
        if len(ids) < 500:
            assert vocab.encode(t) == ids and vocab.decode(ids) == back
    assert bpe.encoded_documents(_docs(spark, ["a"]).limit(0), _path()).count() == 0


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(_path())
    texts = ODD + ["word " * k for k in range(60)] + ["same text here"] * 40
    d = _docs(spark, texts)
    rows = packing.pack(d, _path(), width=64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(d.limit(0), _path()).count() == 0


def test_shortest_pack_first_places_all():
    rng = random.Random(2)
    for _ in range(60):
        width = rng.choice([8, 64, 2048])
        h = {}
        for _ in range(rng.randint(0, 800)):
            n = rng.randint(1, width)
            h[n] = h.get(n, 0) + 1
        got = {}
        for pattern, count in packing.shortest_pack_first(h, width):
            assert sum(n * k for n, k in pattern) <= width
            for n, k in pattern:
                got[n] = got.get(n, 0) + k * count
        assert got == h


def test_pii_spans(spark):
    texts = ["mail me: a.b@c.de or x@y", "ip 1.2.3.4 and 1.2.3.999", "card 4111 1111 1111 1111", "+1 (555) 010-9999", "iban DE89 3704 0044 0532 0130 00", "no", None, "ssn 123-45-6789"]
    got = {r.doc_id: r for r in pii.personal_data(_docs(spark, texts)).collect()}
    assert got[0].spans == "email:9:17" and got[0].base_sha256 == _sha("email:9:17")
    assert got[1].n_ip == 1 and got[2].n_card == 1 and got[3].n_phone == 1
    assert got[4].spans.startswith("iban:") and got[7].spans == "ssn:4:15" and got[6].spans == "" and got[6].base_sha256 == _sha("")
    clean = [r.m for r in _docs(spark, texts).orderBy("doc_id").select(pii.masked(F.col("text")).alias("m")).collect()]
    assert clean[0] == "mail me: [email] or x@y" and clean[5] == "no" and clean[6] is None
    assert pii.find_spans(LONG) == [] and pii.personal_data(_docs(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("n,k,steps", [(5, 3, 2), (6, 2, 4), (4, 3, 256), (1, 3, 4)])
def test_forward_backward_matches_enumeration(n, k, steps):
    rng = np.random.default_rng(n)
    scores, moves, starts = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    heads = rng.random(n) < 0.3
    heads[0] = True
    want = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[i, y] + (starts[y] if heads[i] else moves[path[i - 1], y]) for i, y in enumerate(path)))
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(langid.posteriors(scores, heads, moves, starts, steps), want / want.sum(1, keepdims=True))


@pytest.mark.parametrize("n,k,steps", [(5, 3, 2), (6, 2, 4), (4, 3, 256)])
def test_expected_moves_match_enumeration(n, k, steps):
    rng = np.random.default_rng(n)
    scores, moves, starts = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    heads = rng.random(n) < 0.3
    heads[0] = True
    want, total = np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[i, y] + (starts[y] if heads[i] else moves[path[i - 1], y]) for i, y in enumerate(path)))
        total += w
        for i in range(1, n):
            want[path[i - 1], path[i]] += 0.0 if heads[i] else w
    got = langid.expected_moves(scores, heads, moves, *langid.messages(scores, heads, moves, starts, steps))
    assert np.allclose(got, want / total)


def test_runs_of_a_switched_text(spark):
    en, de = "the cat sat on the mat and then it ran off to the hill", "der hund lief durch das haus und dann schlief er auf dem boden"
    texts = [en, de] * 20 + [f"İ! {en} -- {de}. {en}", "123", None, en.upper() + "!", (en + " ") * 20000 + de]
    got = [r for r in langid.identify(_docs(spark, texts, ["en", "de"] * 20 + [None] * 5)).orderBy("doc_id").collect()]
    assert [r.lang for r in got[40].runs] == ["en", "de", "en"] and texts[40][got[40].runs[1].start : got[40].runs[1].end] == de
    assert got[41].runs == got[42].runs == [] and [(r.start, r.end) for r in got[43].runs] == [(0, len(en))]
    assert [(r.lang, texts[44][r.end - 4 : r.end]) for r in got[44].runs] == [("en", "hill"), ("de", "oden")]


def test_language_identification(spark):
    en, de = "the cat sat on the mat and then it ran off to the hill", "der hund lief durch das haus und dann schlief er auf dem boden"
    texts = [en, de] * 20 + [None, "123 !!", LONG]
    d = _docs(spark, texts, ["en", "de"] * 20 + [None, "en", None])
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(got[k].lang_pred == ("en", "de")[k % 2] for k in range(40))
    assert got[40].lang_pred == got[41].lang_pred == "und" and got[40].score == 0 and 0 <= got[42].score <= 1
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert langid.keep_known(d).columns == d.columns
    assert {r.lang_pred for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(d.limit(0)).count() == 0


def test_filter_keeps_switched_and_unlabelled_texts(spark):
    words = {"de": "der hund lief durch das haus und", "en": "the cat sat on the mat and", "es": "el perro come en la calle y", "fr": "le chat dort dans une maison et"}
    switched = " ".join(f"{t} " * 5 for t in words.values())
    d = _docs(spark, [*words.values()] * 15 + [switched, "123 !!", None], [*words] * 15 + [None] * 3)
    score = langid.identify(d).where("doc_id = 60").first().score
    kept = {r.doc_id for r in langid.keep_known(d).collect()}
    assert score < 0.35 and kept == set(range(61))
    assert {r.doc_id for r in langid.keep_known(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == set(range(61))


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.95


def test_toxicity_finds_and_spares(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.severities(d, l).withColumnRenamed("toxic", "p").join(l, "doc_id")
    r = got.select(F.avg(F.when(F.col("toxic") == 1, F.col("p").cast("double"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("p").cast("double"))).alias("false")).first()
    assert r.recall > 0.85 and r.false < 0.01
    none = l.limit(0)
    odd = toxicity.severities(_docs(spark, ODD), none).collect()
    assert len(odd) == len(ODD) and all(x.severity == 0 and not x.toxic for x in odd)


def test_quality_rank_and_selection(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.resample(d, l).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    known = [r.quality for r in l.where("quality IS NOT NULL").collect()]
    assert sum(r.selected for r in rows) == round(sum(q == 1 for q in known) / len(known) * len(rows))
    assert [r["key"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r["key"] for r in rows), reverse=True)
    odd = quality.resample(_docs(spark, ODD), l.limit(0)).collect()
    assert len(odd) == len(ODD) and all(r.log_weight == 0 for r in odd)
    assert quality.resample(_docs(spark, ["a"]).limit(0), l).count() == 0


def _classes(pairs, ids):
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def _words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def _alignment(x, y):
    """Similarity of two word lists by the whole table of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = row
        row = [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1]) if x and y else 0.0


def test_banded_alignment_matches_the_whole_table():
    rng = random.Random(7)
    seen = set()
    for _ in range(400):
        x = [rng.randrange(rng.choice((3, 12, 60))) for _ in range(rng.randint(0, 70))]
        y = [v for v in x if rng.random() > 0.06]
        for _ in range(rng.randint(0, 8)):
            y.insert(rng.randint(0, len(y)), rng.randrange(60))
        linked, value = minhash.aligned(np.array(x, np.uint64), np.array(y, np.uint64))
        want = _alignment(x, y)
        assert linked == (want >= 0.8)
        assert value == pytest.approx(want) if linked else value >= want - 1e-9
        seen.add(linked)
    assert seen == {True, False}


def test_near_copies_with_edits_are_caught(spark):
    """Documents of 30 to 400 words of which up to 5 % are changed, dropped or added: at least 0.9 of the pairs, no clean document."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    texts, base_of = [], []
    for b in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for c in range(3):
            copy = list(base)
            for _ in range(len(base) // 20 if c else 0):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            texts.append(" ".join(copy))
            base_of.append(b)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(_docs(spark, texts)).collect()}
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if base_of[i] == base_of[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(base_of[i] == base_of[c] for i, c in got.items())


def test_large_group_beside_documents_with_its_passage(spark):
    """Near copies of one text and unrelated documents that hold most of it: buckets stay mixed and are settled exactly."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    core = [rng.choice(words) for _ in range(90)]
    texts = []
    for _ in range(60):
        copy = list(core)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(copy))
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(18, 40))]
        texts.append(" ".join(core + own))
        if rng.random() < 0.3:
            texts.append(" ".join(core + own[:-2]))
    h = [_words_of(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if _alignment(h[i], h[j]) >= 0.8]
    want = _classes(pairs, range(len(texts)))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(_docs(spark, texts), rounds=1).collect()} == want


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_duplicates_match_brute_force(spark, rounds):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = ODD[:7] + [LONG]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(8, 150))]
        texts += [" ".join(base)] * 2
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    h = [_words_of(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if (texts[i] or "") == (texts[j] or "") or _alignment(h[i], h[j]) >= 0.8]
    want = _classes(pairs, range(len(texts)))
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, texts), rounds=rounds).collect()}
    assert {k: r.class_id for k, r in got.items()} == want
    assert sorted(k for k, r in got.items() if r.kept) == sorted(set(want.values()))


def test_near_duplicates_around_the_threshold(spark):
    """One passage with various ends, so that pairs lie around 0.8, and the same in another order."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(2000)]
    core = [rng.choice(words) for _ in range(70)]
    texts = [" ".join(core), " ".join(core[35:] + core[:35]), " ".join(core[36:] + core[:36])]
    for _ in range(90):
        copy = core[rng.randint(0, 6) :] + [rng.choice(words) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.2:
            copy = copy[40:] + copy[:40]
        texts.append(" ".join(copy))
    h = [_words_of(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if _alignment(h[i], h[j]) >= 0.8]
    want = _classes(pairs, range(len(texts)))
    assert 2 < len(set(want.values())) < len(texts)
    got = minhash.near_duplicates(_docs(spark, texts), rounds=1).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_near_duplicates_repeated_rows_and_empty(spark):
    d = _docs(spark, ["one two three four five six", "seven"])
    kept = minhash.keep_first(d.unionByName(d))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def _least_cost(roles):
    """Cheapest legal conversation, by trying every sequence of states."""
    best = np.inf
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        s, cost = 0, 0.0
        for r, t in zip(roles, states):
            step = {(a, b): c for a, b, c in chat._moves(r)}.get((s, t))
            if step is None:
                cost = np.inf
                break
            cost, s = cost + step, t
        best = min(best, cost + chat._close(s) if cost < np.inf else np.inf)
    return best


def test_chat_repair(spark):
    rng = random.Random(5)
    names = ["user", "assistant", "system", "Human", "tool", None]
    convs = {c: [rng.choice(names) for _ in range(rng.randint(1, 6))] for c in range(40)}
    rows = [(c, k, r, f"t{k}") for c, rs in convs.items() for k, r in enumerate(rs)]
    for segment in (2, 512):
        got = chat.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment=segment).collect()
        assert len(got) == len(rows)
        for c, rs in convs.items():
            mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
            cost = sum(chat.MERGE * ("merge" in r.action) + chat.RELABEL * ("relabel" in r.action) + chat.INSERT * len([x for x in r.inserted.split(",") if x]) for r in mine)
            assert cost == _least_cost([chat.state_of(r) for r in rs])
            text = "".join(r.rendered for r in mine)
            heads = [x.split("|")[1] for x in text.split("\n") if x.startswith("<|") and not x.startswith("<|end")]
            body = heads[1:] if heads[0] == "system" else heads
            assert all(h == ("user", "assistant")[k % 2] for k, h in enumerate(body)) and len(body) % 2 == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.repair_conversations(empty).count() == 0


def test_pipeline_keeps_its_contract(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    step = docs
    for name, f in p.STAGES[:-1]:
        after = f(spark, step, "")
        assert after.columns == docs.columns
        assert after.count() <= step.count()
        step = spark.createDataFrame(after.collect(), docs.schema)
    assert step.join(docs, "doc_id", "left_anti").isEmpty()
    packed = p.STAGES[-1][1](spark, step, "")
    assert packed.select("doc_id").distinct().count() == step.select("doc_id").distinct().count()


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _base_by_re(text):
    """The contract's patterns, leftmost and non-overlapping for each kind."""
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda f: (f[1], pii.KINDS.index(f[0])))


def test_base_spans_match_plain_patterns():
    rng = random.Random(21)
    bits = list("0123456789") + list(" -.+()@ab_%") + ["4111 1111 1111 1111", "1.2.3.4", "a.b@c.de", "+1 (555) 010-9999", "é", "\n"]
    seen = 0
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        got = [(k, a, b) for k, a, b, _ in pii.find_spans(text) if k in pii.BASE]
        assert got == _base_by_re(text), text
        seen += len(got)
    assert seen > 500


def test_personal_data_in_very_long_matches(spark):
    zeros = "0" * 5000
    texts = [f"1.2.3.{zeros}1", f"{zeros}1.2.3.{zeros}256", "4" * 6000, "a" * 20000 + "@" + "b." * 9000 + "c", None, "1.2.3.4", "1.2.3.4"]
    d = _docs(spark, texts)
    got = pii.personal_data(d.unionByName(d)).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        want = _base_by_re(texts[r.doc_id] or "")
        assert r.base_sha256 == _sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert r.n_ip == sum(k == "ip" for k, _, _ in want)
    assert {r.doc_id: r.n_ip for r in got}[0] == 1


def test_pieces_of_long_texts_give_the_same(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "İ", "Σ", " ", "  ", "1", "!", "!!!", "é", "_", "\u0307", "ß", "'"]) for _ in range(400)) for _ in range(30)] + ["a " + "!" * 300, "x" * 500, "", "Σ" * 90]
    model = langid.fit([(["the", "cat", "ab"] * 20, "en"), (["le", "chat", "é"] * 20, "fr")])

    def told():
        return [
            (minhash.word_hashes(t).tolist(), quality.ngrams(t).tolist(), [w for ws in langid._words(t) for w in ws], [a.tolist() for _, at in langid._placed(t) for a in at], langid.label([t], model))
            for t in texts
        ]

    whole = told()
    monkeypatch.setattr(text_pieces.pieces, "__defaults__", (7,))
    assert max(len(list(langid._words(t))) for t in texts) > 10
    assert told() == whole


def test_every_letter_counts_for_the_language():
    model = langid.fit([(["the", "cat", "of"] * 20, "en"), (["le", "chat", "de"] * 20, "fr")])
    named = langid.label(["H\u2082O", "m\u00b2", "\u00b2 \u00bd 12", None, "12 !"], model)
    assert [x[0] == langid.UND for x in named] == [False, False, True, True, True]
    a, b = "th" * 40 + "e" * 60 + "th" * 40, "th" * 40 + "q" * 60 + "th" * 40
    assert langid.word_features(a, {}) != langid.word_features(b, {})
    long = "the" * 2000
    direct = model.weights[langid.word_features(long, model.lexicons)].sum(0, dtype=np.float64) / np.sqrt(len(langid.word_features(long, model.lexicons)))
    assert np.allclose(model.emissions(["cat", long])[1], direct, atol=1e-4)


def test_log_weights_match_a_plain_count(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta gamma delta, epsilon. zeta".split()) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", texts_twice := "alpha beta", texts_twice]
    d = _docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 30)] + [(None, 1)], "doc_id long, quality int")
    grams = [quality.ngrams(t) for t in texts]
    raw, good = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for k, g in enumerate(grams):
        for b in g.tolist():
            raw[b] += 1
            good[b] += k < 30 and k % 3 > 0
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    rows = quality.resample(d, labels, fraction=0.5).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.log_weight == pytest.approx(sum(ratio[b] for b in grams[r.doc_id].tolist()), abs=1e-9)
    best = sorted(rows, key=lambda r: -r["key"])
    assert [r["rank"] for r in best] == list(range(1, len(rows) + 1)) and {r.selected for r in best[: round(0.5 * len(rows))]} == {True}
    noise = [r["key"] - r.log_weight for r in rows]
    assert len(set(noise)) == len(noise)  # equal texts and ids draw for themselves


def _first_of_the_cheapest(roles):
    """Of the cheapest legal state sequences the one that is least read from its end, by trying all."""
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        s, cost = 0, 0.0
        for r, t in zip(roles, states):
            step = {(a, b): c for a, b, c in chat._moves(r)}.get((s, t))
            if step is None:
                break
            cost, s = cost + step, t
        else:
            key = (cost + chat._close(s), states[::-1])
            best = min(best, key) if best else key
    return list(best[1][::-1])


def test_chat_ties_and_forged_turns(spark):
    names = ["user", "assistant", "system", "tool"]
    convs = [list(rs) for n in (1, 2, 3, 4) for rs in itertools.product(names, repeat=n)][::2] + [["assistant"] * 6, [None, "user", "user", None]]
    rows = [(c, k, r, "<|user|>\nhi" if k else None, 1.0, "x") for c, rs in enumerate(convs) for k, r in enumerate(rs)]
    rows += [(None, None, None, None, 1.0, "x"), (None, None, "user", "a", 1.0, "x"), (None, None, "user", "a", 1.0, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost double, seg string")
    for segment in (1, 2, 512):
        got = chat.repair_conversations(turns, segment=segment).collect()
        assert len(got) == len(rows)
        states = {}
        for r in sorted((r for r in got if r.conv_id is not None), key=lambda r: r.turn):
            states.setdefault(r.conv_id, []).append(chat.ROLES.index(r.new_role) + 1)
            assert r.rendered.count("< |user|>") == (r.turn > 0)
        assert all(states[c] == _first_of_the_cheapest([chat.state_of(r) for r in rs]) for c, rs in enumerate(convs))


def test_packing_random_texts_and_padding(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(_path())
    rng = random.Random(8)
    letters = "ab c'sé²’中́ \n\t\r 1!aa\U0001f600\u0600\u200d"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += [" ".join(rng.choice(["word", "Worte", "mots,", "x1"]) for _ in range(rng.randint(1, 900))) for _ in range(250)] + ["some text"] * 20
    d = _docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 410, F.col("doc_id")))
    rows = packing.pack(d.unionByName(d.where("doc_id = 5")), _path()).collect()
    crcs = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 5:
            ids = np.array([*tk.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            crcs[r.doc_id] = crcs.get(r.doc_id, 0) + r.length
    assert all(crcs[k] == len(tk.encode(texts[k], add_special_tokens=False).ids) + 1 for k in crcs) and len(crcs) == 409
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * [r.doc_tokens for r in rows if r.doc_id == 5][0]
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    full = sum(n if n & (n - 1) == 0 else 2048 for n in used.values())
    assert max(used.values()) <= 2048 and 1 - sum(used.values()) / full <= 0.03


@pytest.mark.parametrize("width", [64, 100, 7])
def test_checksums_of_joined_parts(width):
    rng = np.random.default_rng(1)
    for n in (1, 3, 63, 64, 65, 1000):
        raw = rng.integers(0, 50000, n).astype("<u4").tobytes()
        fine = packing._cuts(n, width, packing._finest(width))
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(fine, fine[1:])]
        for rest in {width, *(packing._finest(width) << k for k in range(packing.HALVINGS))}:
            got = packing._pieces(n, crcs, width, min(rest, width))
            assert sum(k for _, k, _ in got) == n
            assert all(c == zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k, c in got)


def test_pipeline_matches_brute_force(spark):
    """All stages on a small table against plain versions of them."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    rng = random.Random(2)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    for r in base[:8]:
        words = (r.text or "").split(" ")
        for k in range(len(words) // 25):
            words[rng.randrange(len(words))] = f"changed{k}"
        rows.append((1000 + r.doc_id, " ".join(words), r.lang, r.source, 1))
        rows.append((2000 + r.doc_id, f"  {r.text}\n", r.lang, r.source, 1))
    rows += [(3000, None, "en", None, None), (3001, "", None, "s", 0), (3002, "12 34 !!", "en", "s", 8), (3003, "write to a.b@c.de please", "en", "s", 24), (3003, "write to a.b@c.de please", "en", "s", 24), (None, "the cat sat on the mat", "en", "s", 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    told = langid.label([r[1] for r in rows], langid.fit_documents(docs))
    left = [r for r, (lang, _, sure) in zip(rows, told) if lang != langid.UND and sure >= 0.35]
    groups = {}
    for r in left:
        groups.setdefault(re.sub(r"[ \t-\r]", "", r[1]), []).append(r)
    order = lambda r: (r[0] is None, r[0] or 0)
    left = [min(g, key=lambda r: (-len(r[1]), *order(r))) for g in groups.values()]
    left.sort(key=order)
    words = [_words_of(r[1]) for r in left]
    near = [(i, j) for j in range(len(left)) for i in range(j) if _alignment(words[i], words[j]) >= 0.8]
    classes = _classes(near, range(len(left)))
    left = [left[k] for k in sorted(set(classes.values()))]
    tk = Tokenizer.from_file(_path())
    want = {}
    for r in left:
        text = pii._mask(r[1], pii.find_spans(r[1]))
        ids = np.array([*tk.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want[r[0]] = (len(ids), zlib.crc32(ids.tobytes()))

    step = docs
    for name, f in p.STAGES[:-1]:
        step = f(spark, step, "")
        assert step.columns == docs.columns
    got = {}
    for r in p.STAGES[-1][1](spark, step, "").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for k, parts in got.items():
        assert sum(r.length for r in parts) == want[k][0] == parts[0].doc_tokens
        if len(parts) == 1:
            assert parts[0].ids_crc32 == want[k][1]
    empty = docs.limit(0)
    for name, f in p.STAGES:
        assert f(spark, empty, "").count() == 0
