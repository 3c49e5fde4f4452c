"""Operators 1, 2, 3, 6, 8 and 10 against brute force, held-out accuracy and exact round trips."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeprep.llm import bpe, langid, packing, pii, quality, queries, secrets
from tests.llm import cases

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_langid(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_kneser_ney_sums_to_one():
    counts = {"x": Counter("   abracadabra "[i:i + 4] for i in range(12)), "y": Counter("   banana bandana "[i:i + 4] for i in range(14))}
    m = langid.build(counts)
    letters = sorted({g[-1] for c in counts.values() for g in c})
    for context in ("   ", "bra", "ana", "qqq", "aba"):
        x = np.array([[ord(c) for c in context + last] for last in letters], np.uint32).ravel()
        hashes = {k: np.append(np.zeros(k - 1, np.uint64), langid.gram_hashes(x, k)) for k in range(1, 5)}
        p = np.exp(m.log_p(hashes, 4, np.arange(3, len(x), 4)).astype(float))
        # the rest belongs to characters never seen, each as likely as the floor at least
        assert np.all(p.sum(0) <= 1 + 1e-5) and np.all(p.sum(0) > 0.7)


def test_language_edges(spark):
    df = cases.table(spark)
    model = langid.learn(df)
    got = cases.by_id(langid.predict(df, model))
    assert sum(map(len, got.values())) == df.count()
    for d in (4, 5, 6):
        assert (got[d][0].lang_pred, got[d][0].score) == ("und", 0.0)
    assert got[20][0].lang_pred == "de" and got[1][0].lang_pred == "en"
    assert langid.learn(cases.empty(spark)) is None
    assert langid.predict(df, None).where("lang_pred <> 'und'").count() == 0


def base_counts(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_quality_counts_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(cases.texts_of(docs))
    got = queries.op2_quality(spark, SF).collect()
    for r in got:
        assert tuple(r[1:6]) == base_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [r for r in got if r.doc_id in label and not r.base_failed]
    assert sum(r.kept == bool(label[r.doc_id]) for r in judged) >= 0.9 * len(judged)


def test_quality_edges(spark):
    df = cases.table(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (100, None)], "doc_id bigint, quality int")
    assert quality.learn(df, labels) is None
    got = quality.judge(df, None, ["doc_id", "id"]).collect()
    assert len(got) == df.count()
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: r.id), cases.rows()):
        assert tuple(r[2:7]) == base_counts(text)
        assert r.kept == (not r.base_failed)
    assert quality.judge(cases.empty(spark), None).count() == 0


def test_bpe_matches_the_library():
    t, c, rng = Tokenizer.from_file(PATH), bpe.Codec(bpe.read_spec(PATH)), random.Random(3)
    texts = [x or "" for _, x, *_ in cases.rows()]
    texts += ["".join(rng.choice(["a", "b", " ", "<|endoftext|>", "\n", "'s", "1", "é", "漢", "\x1c", "\x85", "  ", "՘"]) for _ in range(80)) for _ in range(400)]
    texts += [" lead", "  two", "a   three", "a \n b", "a \n \n b", "tail ", "tail  ", "\n \n", "x" * 500, "'LL'll don't"]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == np.array(want, "<u4").tobytes(), x[:40]
        assert c.ids(x) == want
        assert c.decode(c.encode(x)) == t.decode(want, skip_special_tokens=False)


def test_bpe_own_merges_match():
    c, t = bpe.Codec(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)
    for x in ("hello", " thesesereing", "a" * 300, "überschön", "!!!???"):
        assert [i for f in c.fragments(x.encode()) for i in bpe.Codec.encode_fragment(c, f)] == t.encode(x, add_special_tokens=False).ids or len(x) > 40 or " " in x
    for ids in ([1, 2, 3], [50256], [255, 128]):
        assert c.decode(np.array(ids, "<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark):
    t = Tokenizer.from_file(PATH)
    df = cases.table(spark)
    got = bpe.digests(df, PATH, key="id").collect()
    assert len(got) == df.count()
    texts = {i: r[1] or "" for i, r in enumerate(cases.rows())}
    for r in got:
        ids = t.encode(texts[r.id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha256(texts[r.id].encode()).hexdigest()
    assert bpe.encode_decode(cases.empty(spark), PATH).count() == 0


def test_packing(spark):
    t, df = Tokenizer.from_file(PATH), cases.table(spark).repartition(5)
    got = packing.pack(df, PATH, size=64, key="id").collect()
    texts = {i: r[1] or "" for i, r in enumerate(cases.rows())}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        ids = t.encode(texts[i], add_special_tokens=False).ids + [0]
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for s, own in sequences.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == 64 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.piece_digests(cases.empty(spark), PATH).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def pii_reference(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


def secret_reference(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24])


def noise(n=1500):
    rng = random.Random(5)
    parts = ["a", "@", ".", "1", "9", "25", " ", "-", "+", "(", ")", "\n", "%", "é", "4111 1111 1111 1111", "12.3.4.5", "token", "=", '"', "'", ":", "AKIA",
             "ABCDEFGHIJ0123", "deadbeef0123", "Password", "api_key", "secret", "ſecret", "٣"]
    return ["".join(rng.choice(parts) for _ in range(60)) for _ in range(n)]


def test_base_spans():
    for t in noise() + [r[1] or "" for r in cases.rows()]:
        assert pii.base_spans(t) == pii_reference(t)
        assert secrets.base_spans(t) == secret_reference(t)


def test_pii_query(spark):
    df = cases.table(spark)
    w = pii.learn(df)
    got = cases.by_id(pii.scan(df, w))
    assert sum(map(len, got.values())) == df.count()
    assert (got[9][0].n_email, got[9][0].n_ip, got[9][0].n_phone) == (1, 1, 1)
    assert got[4][0].spans == got[5][0].spans == got[7][0].spans == ""
    assert pii.learn(cases.empty(spark)) is None
    assert pii.scan(cases.empty(spark), None).count() == 0


def test_semi_markov_adds_what_the_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    w = pii.learn(docs)
    find = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.spans(t, w)[1]]
    assert find("call (414) 555-1791 now") == [("phone", "(414) 555-1791")]
    assert find("mail joe.b[at]mail.example.com ok") == [("email", "joe.b[at]mail.example.com")]
    assert find("in 2024 we paid 12 for 3.5 of it. Version 2.0.") == []


def test_long_stretches_are_segmented_as_a_whole(spark, monkeypatch):
    text = "(414) 555-1791, " * 150
    w = pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = pii.spans(text, w)[1]
    assert [(k, text[s:e]) for k, s, e in found] == [(3, "(414) 555-1791")] * 150
    rng = np.random.default_rng(3)
    tokens = pii.TOKEN.findall(" ".join(str(x) + rng.choice([".", " ", "-", "@a.b"]) for x in rng.integers(0, 5000, 200)))
    w = rng.normal(size=(5, 1 << pii.BITS))
    blocks = pii.best(tokens, w)
    monkeypatch.setattr(pii, "REGION_TOKENS", len(tokens))
    assert len(tokens) > 400 and [x[:3] for x in blocks] == [x[:3] for x in pii.best(tokens, w)]


def test_a_single_number_competes_by_its_score():
    w = np.zeros((5, 1 << pii.BITS))
    w[4, pii._hash("n:10:False")] = 9
    text = "call 4145551791 or 12"
    assert pii.spans(text, w)[1] == [(3, 5, 15)]


def test_semi_markov_gradient_is_a_distribution():
    g = pii.lattice(pii.TOKEN.findall("at 12.3.4.5 or 7"))
    w = np.random.default_rng(1).normal(size=(5, 1 << pii.BITS)) * 0.1
    p = pii.gradient(g, w, {})
    covered = np.zeros(g.n)
    for k, (a, b) in enumerate(zip(g.starts, g.ends)):
        covered[a:b] += p[:, k].sum()
    assert np.allclose(covered, 1)  # each token lies in one segment


def segmentations(n, allowed):
    """All ways to cut ``n`` tokens into the allowed segments."""
    if n == 0:
        return [[]]
    return [rest + [(i, n)] for i in range(n) if (i, n) in allowed for rest in segmentations(i, allowed)]


def test_best_segmentation_is_that_of_trying_all():
    """Short inputs, random weights: the program's choice scores as high as the
    best of all segmentations and kinds, and its gains add up to that score."""
    rng = random.Random(8)
    for seed in range(60):
        tokens = pii.TOKEN.findall("".join(rng.choice(["1", "25", " ", "@", ".", "a", "\n", "at", "(", "-"]) for _ in range(rng.randint(1, 9))))
        w = np.random.default_rng(seed).normal(size=(5, 1 << pii.BITS))
        g = pii.lattice(tokens)
        s = pii.scores(g, w)
        of = {(i, j): s[:, k] for k, (i, j) in enumerate(zip(g.starts.tolist(), g.ends.tolist()))}
        top = max(sum(of[x].max() for x in cut) for cut in segmentations(len(tokens), of))
        none = [of[i, i + 1][0] for i in range(len(tokens))]
        found = pii.best(tokens, w)
        assert np.isclose(top - sum(none), sum(gain for *_, gain in found))
        for kind, i, j, gain in found:
            assert np.isclose(of[i, j][kind + 1] - sum(none[i:j]), gain) and of[i, j].argmax() == kind + 1


def test_features_tell_what_they_say():
    """Each feature against a plain definition: equal values have equal ids."""
    def plain(tokens, i, j):
        span, before, after = tokens[i:j], tokens[i - 1] if i else "^", tokens[j] if j < len(tokens) else "$"
        parts = [t for t in span if t[0] in "0123456789"]
        text, letters = "".join(parts), any(t[0].isalpha() for t in span)
        other = frozenset(t for t in span if not t[0].isalnum())
        kind = lambda t: "d" if t[0] in "0123456789" else "a" if t[0].isalpha() else " " if t.isspace() else t
        size = lambda t: len(t) if kind(t) in "da" else 0
        edge = (span[0][0].isalnum() or span[0] in "+(", span[-1][0].isalnum())
        marked = any(t == "@" or k and t.lower() == "at" and span[k - 1] in "[(" for k, t in enumerate(span))
        byte = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        loose = before[0].isalnum() or before in ".@-_" or after[0].isalnum() or after in "@_"
        return [0, tuple(map(kind, span)), tuple((kind(t), size(t)) for t in span), (len(text), letters), (len(parts), other, letters),
                (len(text) >= 16 and luhn(text), letters), (len(parts) == 4 and byte, other, letters), (marked, letters, edge), edge, loose,
                (before[0].isalnum(), edge), (after[0].isalnum(), edge), (j - i, letters), (tuple(min(len(p), 5) for p in parts[:6]), letters)]
    rng, known = random.Random(2), [{} for _ in range(14)]
    signs = ["a", "@", ".", "1", "9", "250", "300", " ", "  ", "-", "+", "(", ")", "\n", "é", "4111 1111 1111 1111", "12.3.4.5", "at", "[", "_", "²", "٣"]
    for _ in range(60):
        tokens = pii.TOKEN.findall("".join(rng.choice(signs) for _ in range(rng.randint(1, 25))))
        g = pii.lattice(tokens)
        for i, j, ids in zip(g.starts.tolist(), g.ends.tolist(), g.features.tolist()):
            for seen, value, x in zip(known, plain(tokens, i, j), ids):
                assert seen.setdefault(value, x) == x
    assert all(len(set(seen.values())) > 0.7 * len(seen) for seen in known)  # few values share an id


def test_digits_of_other_scripts_and_long_numbers(spark):
    w = pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for t in ("10² m at 3² ٣٣٣ joe@²", "7" * 50_000, "(414) 555-1791 ²" * 2000):
        base, found = pii.spans(t, w)
        assert set(base) <= set(found) and all(0 <= a < b <= len(t) for _, a, b in found)


def test_regions_are_disjoint_and_whole():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b" * 50, " ", "\n", "7", "@", ".", "[at]", "word " * 9, "(414)"]) for _ in range(rng.randint(0, 40)))
        got = pii.regions(t)
        ends = [a + len("".join(w)) for a, w in got]
        assert all(t[a:e] == "".join(w) for (a, w), e in zip(got, ends))
        assert all(e <= a for e, (a, _) in zip(ends, got[1:]))
        assert all((not a or t[a - 1].isspace() or t[a].isspace() or a == 0) and (e == len(t) or t[e].isspace()) for (a, _), e in zip(got, ends))
        inside = {i for (a, _), e in zip(got, ends) for i in range(a, e)}
        assert all(set(range(m.start(), m.end())) <= inside for m in pii.ANCHOR.finditer(t))


def test_many_languages_share_the_sample(spark):
    rows = [(i, (f"{chr(97 + i % 7)}{chr(98 + i % 5)}{chr(105 + i % 3)} " * 30), f"l{i % 105}") for i in range(630)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    old = langid.SHARED_LANGUAGES
    try:
        langid.SHARED_LANGUAGES = 2
        model = langid.learn(df)
    finally:
        langid.SHARED_LANGUAGES = old
    assert len(model.languages) == 105


def test_constants_have_their_own_spans():
    prose = "A line of prose that is no secret at all.\n" * 5
    text = f'base = "q8Zt1kLmP0"\n{prose}db_password_x = base + "Xy7Kq2Rt9W"\n'
    found = secrets.spans(text)[1]
    assert [text[a:b] for a, _, b in found] == ["q8Zt1kLmP0", "Xy7Kq2Rt9W"]
    assert secrets.redact(text, found) == f'base = "[SECRET]"\n{prose}db_password_x = base + "[SECRET]"\n'
    text = "k = `q8Zt1kLmP0zz`; " + "k = k + k; " * 200 + "my_secret_part := k"
    assert secrets.spans("my_secret_part := `q8Zt1kLmP0zz`")[1] == [(19, 3, 31)]
    assert secrets.redact(text, secrets.spans(text)[1]).replace("[SECRET]", "q8Zt1kLmP0zz") == text


def test_text_outside_literals_survives():
    """Random programs: only literals that a slow reading of the assignments leads to are touched."""
    rng = random.Random(11)
    for _ in range(300):
        values, parts, lines, at = {}, {}, [], 0
        literal = []
        for k in range(rng.randint(1, 14)):
            if rng.random() < 0.3:
                line = "plain words that say nothing much"
            else:
                name = rng.choice(["base", "part_a", "db_password", "client_secret_x", "note", "width"])
                terms, value, places, ok = [], "", [], True
                offset = at + len(name) + 3
                for _ in range(rng.choice([1, 1, 2, 3])):
                    if terms:
                        offset += 3
                    if rng.random() < 0.4:
                        other = rng.choice(["base", "part_a", "note", "unknown_name"])
                        terms.append(other)
                        offset += len(other)
                        ok = ok and other in values
                        if other in values:
                            value, places = value + values[other], places + parts[other]
                    else:
                        v = "".join(rng.choices("abcXYZ0189-", k=rng.randint(0, 14)))
                        terms.append(f'"{v}"')
                        literal.append((offset + 1, offset + 1 + len(v)))
                        value, places = value + v, places + [(offset + 1, offset + 1 + len(v))]
                        offset += len(v) + 2
                line = f"{name} = {' + '.join(terms)}"
                if ok:
                    values[name], parts[name] = value, places
            lines.append(line)
            at += len(line) + 1
        text = "\n".join(lines) + "\n"
        base, found = secrets.spans(text)
        added = [(a, b) for a, k, b in found if k == 3]
        assert set(added) <= set(literal) and all(b1 <= a2 for (_, b1), (a2, _) in zip(added, added[1:]))
        kept = [c for i, c in enumerate(text) if not any(a <= i < b for a, _, b in found)]
        assert "".join(kept) == secrets.redact(text, found, "")


def test_secrets(spark):
    find = lambda t: [(secrets.KINDS[k], t[a:b]) for a, k, b in secrets.spans(t)[1]]
    assert find('KEY = "zX81kQp0aa9Lw"\ndb_pwd = KEY\n') == [("literal", "zX81kQp0aa9Lw")]
    assert find("client.secret => 'a8f9-AA7-lq19'") == [("literal", "a8f9-AA7-lq19")]
    assert find("url = 'http://example.com/abc'\nname: value\ncount = 123456789") == []
    assert find("signing_key: 'changeme'") == []
    df = cases.table(spark)
    got = cases.by_id(secrets.scan(df))
    assert sum(map(len, got.values())) == df.count()
    assert (got[10][0].n_assign, got[10][0].n_hex, got[12][0].n_access) == (1, 1, 1)
    assert "44a0f5b6" not in got[10][0].redacted and got[4][0].redacted == ""
    assert secrets.scan(cases.empty(spark)).count() == 0


def test_no_python_rows_are_lost_over_many_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc "), F.col("id").cast("string")).alias("text"))
    assert secrets.scan(df.repartition(7)).count() == 500
