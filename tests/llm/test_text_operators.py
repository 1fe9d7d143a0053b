import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import langid, records, secrets, toxicity

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


# toxicity


def test_folding():
    assert toxicity.fold("You 1DIOT, m0ron! іdiot stup!d tr4sh") == "you idiot, moron! idiot stupid trash"
    assert toxicity.fold("ｉｄｉｏｔ") == "idiot" and toxicity.fold("3 of 5th 100% a 2b") == "3 of sth 100% a 2b"
    assert toxicity.fold("идея о мире") == "идея о мире"  # words of another script stay as they are


def test_exception_phrases_and_word_starts():
    lexicon = toxicity.Lexicon({"clown": 3.0, "idiot": 4.0})
    found = lambda t: toxicity.measure(toxicity.fold(t), lexicon.automaton())
    assert found("what a clown") == (3.0, 1) and found("the clown fish swam") == (0, 0) and found("subclown") == (0, 0)
    assert found("idiotic clowns") == (7.0, 2)


def test_longest_stem_counts_once():
    assert toxicity.measure("stupidly", toxicity.Lexicon({"stup": 1.0, "stupid": 2.0}).automaton()) == (2.0, 1)


def naive_measure(folded, lexicon):
    """The same rule word start by word start, without an automaton."""
    excused = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i) and not (i and folded[i - 1].isalpha()) and not folded[i + len(p) : i + len(p) + 1].isalpha()]
    total, hits = 0.0, 0
    for i in range(len(folded)):
        if i and folded[i - 1].isalpha():
            continue
        stems = [s for s in lexicon.weights if folded.startswith(s, i)]
        if stems and not any(a <= i < b for a, b in excused):
            total += lexicon.weights[max(stems, key=len)]
            hits += 1
    return total, hits


@given(st.text(alphabet="cloCL0wn1dit! -éо", max_size=60) | st.lists(st.sampled_from(["clown", "clown fish", "idiot", "1d10t", "clo", "subclown", "idiotic", ",", "class clown", "sore loser", "loser"]), max_size=12).map(" ".join))
@settings(max_examples=400, deadline=None)
def test_automaton_against_a_naive_scan(text):
    lexicon = toxicity.Lexicon({"clown": 3.0, "clo": 0.5, "idiot": 4.0, "idioti": 5.0, "loser": 2.0})
    folded = toxicity.fold(text)
    assert toxicity.measure(folded, lexicon.automaton()) == pytest.approx(naive_measure(folded, lexicon))


def test_toxicity_query_and_stage_against_a_naive_scan(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    lexicon = toxicity.learn(*toxicity.learning_rows(docs, labels))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        folded = toxicity.fold(r["text"] or "")
        weight, hits = naive_measure(folded, lexicon) if len(folded) < 20_000 else toxicity.measure(folded, lexicon.automaton())
        words = len(folded.split())
        x = [1.0, np.log1p(100.0 * max(weight, 0.0) / max(words, 1)), np.log1p(hits), np.log1p(words) * (hits > 0)]
        want[r["doc_id"]] = 1 / (1 + np.exp(-np.clip(np.dot(x, lexicon.coefficients), -30, 30)))
    got = {r["doc_id"]: r for r in toxicity.op3(spark, SMALL).collect()}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(want) and all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, p in want.items() if p < 0.5}


def test_learning_finds_stems_and_length_matters():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "lo", "ti", "ru", "sen"]) for _ in range(3))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = "zargl" + rng.choice(["", "e", "um"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    lexicon = toxicity.learn(texts, labels)
    assert any(s.startswith("zar") for s in lexicon.weights)
    automaton, w = lexicon.automaton(), np.array(lexicon.coefficients)
    assert all((np.dot(toxicity.features(t, automaton), w) >= 0) == y for t, y in zip(texts, labels, strict=True))


def test_toxicity_held_out(spark):
    pytest.importorskip("pyarrow")
    rows = toxicity.op3(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all() and rows.score.between(0, 1).all()


# language


def test_families_then_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op9(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()


def naive_language(model, text):
    """Votes pair by pair over a dictionary of n-grams of one text."""
    data = bytes(langid.PLAIN[b] for b in text.lower().encode())
    if not any(c.isalpha() for c in text):
        return "und"
    mix = lambda x, salt: ((x * 2654435761 + salt) % (1 << 32)) >> (32 - langid.BITS)
    ids = []
    for i, b in enumerate(data):
        two = b + (data[i - 1] * 257 if i else 0)
        three = two + (data[i - 2] * 66049 if i > 1 else 0)
        ids += [mix(b, 97), mix(two % (1 << 32), 1_000_003), mix(three % (1 << 32), 777_767_777)]

    def winner(names, pairs):
        votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for p in pairs:
            m = sum(float(p.weights[i]) for i in ids) / len(ids) + p.bias
            votes[p.a if m >= 0 else p.b] += 1
            total[p.a] += m
            total[p.b] -= m
        return max(sorted(names), key=lambda n: (votes[n], total[n]))

    own = winner(sorted(model.langs), model.families)
    return winner(model.langs[own], model.within[own])


def test_language_query_against_naive_votes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(*langid.learning_rows(docs))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.op9(spark, SMALL).collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    assert len(rows) > 100 and {r["doc_id"]: got[r["doc_id"]] for r in rows} == {r["doc_id"]: naive_language(model, r["text"] or "") for r in rows}


def test_language_doesnt_depend_on_neighbours(spark):
    model = langid.learn(["der und die"] * 3 + ["the and of"] * 3, ["de"] * 3 + ["en"] * 3)
    texts = ["a", "ab", "", "der", "x" * (1 << 18), "of", "éa", "t"]
    one = [langid.predict_batch(model, pa.array([t])) for t in texts]
    names, scores = langid.predict_batch(model, pa.array(texts))
    assert names == [o[0][0] for o in one] and np.allclose(scores, [o[1][0] for o in one], atol=1e-12)


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, "der und die das " * (2 if i % 2 else 900), "de" if i % 2 else "xx") for i in range(60)]
    rows += [(100 + i, "the of and " * 40_000, "en") for i in range(3)] + [(200, None, "fr"), (201, "12", "it")]
    texts, langs = langid.learning_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10, max_chars=1000)
    assert set(langs) == {"de", "xx", "en"} and langs.count("de") >= 10 and 1 <= langs.count("en") <= 2


def test_language_of_odd_texts():
    model = langid.learn(["der und die das nicht ist"] * 3 + ["the and of to in is"] * 3 + ["le la les des et un"] * 3, ["de"] * 3 + ["en"] * 3 + ["fr"] * 3)
    assert set(model.langs) == {"germanic", "romance"} and len(model.families) == 1
    pred, score = langid.predict_batch(model, pa.array([None, "", "12 !?", "der die das", "the and of", "le la les"]))
    assert pred == ["und", "und", "und", "de", "en", "fr"] and (score[:3] == 0).all()
    assert langid.predict_batch(langid.learn([], []), pa.array(["abc"]))[0] == ["und"]
    one = langid.learn(["abc def"], ["xx"])
    assert langid.predict_batch(one, pa.array(["qqq", "1"]))[0] == ["xx", "und"]


def test_language_of_a_slice_equals_whole():
    model = langid.learn(["der und die"] * 3 + ["the and of"] * 3, ["de"] * 3 + ["en"] * 3)
    texts = pa.array(["x", "der und", "the of " * 90000, "die"])
    assert langid.predict_batch(model, texts.slice(1))[0] == langid.predict_batch(model, texts)[0][1:] == ["de", "en", "de"]


# secrets


def brute_base(text):
    out = []
    low = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for kind, rx, n, group in (("assign", low, 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)):
        at = 0
        while m := rx.search(text, at):
            if len(m[group]) >= n:
                out.append((m.start(), m.end(), kind))
            at = m.end()
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


@given(st.text(alphabet="aefxAKI0129 =:'\"\n.token", max_size=80) | st.sampled_from(["token=abcdef", "API_KEY: 'AKIA" + "A1" * 9, "x " + "0a" * 13 + " password=" + "f" * 30]))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    base, every = secrets.scan(text)
    assert base == brute_base(text) and set(base) <= set(every)


def test_named_spans():
    spans = lambda t: [t[a:b] for a, b, k in secrets.scan(t)[1] if k == "named"]
    assert spans('K = "aB3dE5gH7jK9"\nlogin(credential: K)') == ["aB3dE5gH7jK9"]  # where the constant was written
    assert spans("<privateKey>zX81kk2LmnQ0p</privateKey>") == ["zX81kk2LmnQ0p"]
    assert spans("set bearer 9f8Ae7b6Q5zzW1") == ["9f8Ae7b6Q5zzW1"]
    assert spans('privateKey := "abc" + "D9f8G7h6J5k4"') == ['abc" + "D9f8G7h6J5k4']
    assert spans("colour = 9f8Ae7b6Q5zz\npwd = your_password_here\nkey: value") == []
    assert secrets.scan('db_password = "hunter2hunter2X9"')[1] == [(3, 31, "assign")]
    assert secrets.scan(None) == ([], [])


def test_quoted_and_bare_literals_are_apart():
    named = lambda t: [t[a:b] for a, b, k in secrets.scan(t)[1] if k == "named"]
    own = "aB3dE5gH7jK9"
    assert named(f'x = "{own}"\nprivateKey = "x"') == []
    for use in ("x", "$x", "${x}", '"${x}"', '"$x"'):
        assert named(f'x = "{own}"\nprivateKey = {use}') == [own]
    assert named(f"x = '{own}'\nprivateKey = '${{x}}'") == []  # no variables in single quotes
    assert named(f'x = "{own}"\ny = x\nset privateKey y') == [own]


def test_literals_over_several_lines():
    spans = lambda t: [t[a:b] for a, b, k in secrets.scan(t)[1] if k == "named"]
    assert spans('privateKey = "aB3dE5" +\n    "gH7jK9" \\\n  + \'xY1\'') == ['aB3dE5" +\n    "gH7jK9" \\\n  + \'xY1']
    assert spans('privateKey = "aB3d\\"E5gH7jK9"') == ['aB3d\\"E5gH7jK9']
    assert spans('privateKey = """aB3dE5\ngH7jK9"""') == ["aB3dE5\ngH7jK9"] and spans("privateKey = '''\naB3dE5gH7jK9\n'''") == ["aB3dE5gH7jK9"]
    block = "  -----BEGIN KEY-----\n  aB3dE5gH\n  7jK9xY1z\n  -----END KEY-----"
    assert spans(f"privateKey: |\n{block}\nother: 1") == [block.strip()] and spans(f"privateKey: >-\n{block}") == [block.strip()]
    assert spans("a:\n  privateKey: |\n    aB3dE5gH\n    7jK9xY1z\n  credential: aB3dE5gH7jK9\n") == ["aB3dE5gH\n    7jK9xY1z", "aB3dE5gH7jK9"]


FORMS = ['{} = "{}"', "{}: '{}'", '"{}": "{}",', "{} := {}", "export {}={}", "<{}>{}</{}>", "set {} {}", '{} = """{}"""', "{}: |\n    {}"]


@given(st.lists(st.tuples(st.sampled_from(["privateKey", "credential", "db_pwd", "colour", "x.width", "title"]), st.sampled_from(FORMS), st.text("aZ3k9QxB7m", min_size=2, max_size=24)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_named_spans_of_written_pairs(lines):
    """Texts made of pairs whose places are known: exactly the sensitive names with random literals are found."""
    text, want = "", set()
    for name, form, literal in lines:
        line = form.format(name, literal, name)
        at = len(text) + line.rindex(literal, 0, line.rindex("</") if "</" in line else len(line))
        if secrets.sensitivity(name) * secrets.randomness(literal) >= 0.5:
            want.add((at, at + len(literal)))
        text += line + "\n"
    base, every = secrets.scan(text)
    want = {w for w in want if not any(a <= w[0] and w[1] <= b for a, b, _ in base)}
    assert {(a, b) for a, b, k in every if k == "named"} == want


def test_very_many_spans_take_little_time():
    text = "".join(f"token=abcdef{i}\nprivateKey = 'aB3dE5gH7jK9{i}'\n" for i in range(40_000))
    base, every = secrets.scan(text)
    assert len(base) == 40_000 and len(every) == 80_000


def test_code_points(spark):
    row = secrets.find(spark.createDataFrame([(1, "é😀 token=abcdef")], "doc_id long, text string")).first()
    assert row["spans"] == "assign:3:15" and row["base_sha256"] == hashlib.sha256(b"assign:3:15").hexdigest() and row["n_assign"] == 1


# records


def test_frames_notice_damage():
    data = records.frame(b"hello")
    assert bytes(records.unframe(memoryview(data))) == b"hello"
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)))
    with pytest.raises(ValueError):
        records.unframe(memoryview(data[:-1]))
    n = 3 * records.INDEXED - 1
    index = records.index_bytes(list(range(0, 7 * n + 1, 7)), list(range(n + 1)))
    part = lambda at, size: index[at : at + size]
    for first, last in ((0, n), (0, 0), (n, n), (records.INDEXED, records.INDEXED + 3), (records.INDEXED - 1, 2 * records.INDEXED)):
        assert records.read_index(part, first, last).tolist() == [[7 * k, k] for k in range(first, last + 1)]
    assert len(records.read_index(part)) == n + 1
    for bad in (index[:-1] + b"x", index[:-1], index[:3] + b"x" + index[4:]):
        with pytest.raises(ValueError):
            records.read_index(lambda at, size, bad=bad: bad[at : at + size])
    with pytest.raises(ValueError):
        records.file_system("/shared/records")


@pytest.fixture(scope="module")
def tokenizer():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def same_ids(ours, texts):
    for text in texts:
        assert np.frombuffer(ours.encode(text), ours.dtype).tolist() == ours.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_equals_the_library(tokenizer):
    ours = records.Encoder(tokenizer, kept=20)
    texts = ["Hello, World! it's we'LL don't <|endoftext|> x", "ÀÉ ñ ß İstanbul ΟΔΟΣ Σ é é ́a", "a\x1cb c\x85d\xa0e f​g", "123 4.5 ½ ² ª º ''s 'S abc's.", "", "  ", None, "日本語 テキスト。 😀😀!! naïve… “q”", "x" * 300 + " don't.", "Merhaba İ, dünya", "\x00\x01 \x7f\x80\xad"]
    assert ours.known
    for _ in range(2):
        same_ids(ours, texts)


def test_every_letter_before_every_sign(tokenizer):
    ours = records.Encoder(tokenizer)
    letters = [c for c in map(chr, range(0x11000)) if c.isalpha() and not 0x3400 <= ord(c) < 0xD800]
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    same_ids(ours, [" ".join(f"{c}{s} a{c}{s}b" for c in letters[k::400] for s in signs) for k in range(400)])
    latin = [chr(c) for c in range(256)]
    same_ids(ours, [" ".join(f"{a}{b} {b}{a}'s" for b in latin) for a in latin] + [f"x{a}{b}'{a}" for a in latin for b in latin])


def test_stretches_of_long_texts(tokenizer):
    ours = records.Encoder(tokenizer)
    same_ids(ours, ["don't stop, " * 200_000, "word" * 300_000 + "'s end"])


def test_a_tokenizer_with_other_steps(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    ours = records.Encoder(str(public.path("byte_bpe_50k.json")))
    assert not ours.known
    same_ids(ours, ["Hello  World's\n\n end.", "é😀 <|endoftext|>", None])


@given(st.lists(st.text(max_size=60) | st.text("aB's.,é½ \x1c\xa0İ\u0301", max_size=30), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoder_on_any_text(texts):
    public = pytest.importorskip("public_tokenizers")
    same_ids(records.encoder(str(public.path("word_bpe_49k.json"))), texts)


def test_round_trip(spark, tokenizer):
    rows = records.op2(spark, SF, tokenizer).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    from tokenizers import Tokenizer

    start = 0
    for r, enc in zip(rows.itertuples(), Tokenizer.from_file(tokenizer).encode_batch(list(docs.text), add_special_tokens=False), strict=True):
        ids = np.array([*enc.ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shuffled_reads(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(20)], "doc_id long, text string").coalesce(1)
    entry = records.write(docs, tokenizer, f"file://{tmp_path}/out")[0]
    plain = list(records.read(f"file://{tmp_path}/out", entry["name"]))
    order = np.random.default_rng(1).permutation(entry["records"])
    for k, (row, ids) in zip(order, records.read(f"file://{tmp_path}/out", entry["name"], order), strict=True):
        assert row == plain[k][0] and (ids == plain[k][1]).all()


def test_long_literals_and_names():
    own = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=4400))
    for text in (f'private_key = "{own}"', f"private_key = '{own}'", f"private_key = {own}", f"set private_key {own}", f"<private_key>{own}</private_key>", f'private_key = "{own[:9]}" + "{own[9:]}"'):
        at = text.index(own[:9])
        assert [p[2:] for p in secrets.pairs(text)] == [(at, text.rindex(own[-9:]) + 9)]
    name = "spring.security.oauth2.client.registration.keycloak.signing.private-key"
    assert len(name) > 64 and [p[0] for p in secrets.pairs(f'{name}="x9$Kq!27vLp#"')] == [name]
    assert secrets.scan(f'{name}="x9$Kq!27vLp#"')[1] == [(len(name) + 2, len(name) + 14, "named")]
