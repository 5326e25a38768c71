import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from credlens.llm import langid, markov_secrets, oracle, sentencepiece_codec as sp

WORDS = {"en": "the and of to with this have from they which", "de": "der und nicht schon werden eine auch ich über",
         "fr": "les des une dans pour être avec où élève", "es": "los que para como está niño donde según"}


def sentence(rng, lang, n):
    stems = WORDS[lang].split()
    return " ".join(rng.choice(stems) + (rng.choice(stems)[:3] if rng.random() < 0.5 else "") for _ in range(n))


def test_languages(table, odd):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, 40), lang, "s") for i, lang in enumerate(random.Random(2).choices(sorted(WORDS), k=300))]
    extra = [(i, t, "en", "s") for i, t in odd if i not in (7,)] + [(900, "12 + 3 = 15", "de", None), (901, rows[0][1], None, None), (902, "the " * 400_000, None, None)]
    got = langid.identify(table(rows + extra), sample=30).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got}
    held = [r for r in rows if by_id[r[0]].held_out]
    assert 30 < len(held) < 100 and np.mean([by_id[i].lang_pred == lang for i, _, lang, _ in held]) > 0.97
    assert (by_id[1].lang_pred, by_id[1].score) == ("und", 0) and by_id[3].lang_pred == by_id[900].lang_pred == "und"
    assert by_id[901].lang_pred == rows[0][2] and by_id[902].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(table([])).count() == 0
    assert [r.lang_pred for r in langid.identify(table([(1, "no labels here")])).collect()] == ["und"]


def test_pairwise_machines_separate_within_a_family():
    rng = random.Random(3)
    labels = [lang for lang in WORDS for _ in range(20)]
    model = langid.fit(np.array([langid.features(sentence(rng, lang, 30)) for lang in labels]), labels)
    assert model.families == ["germanic", "romance"] and set(model.machines) == {("de", "en"), ("es", "fr")}
    assert all(model.predict(langid.features(sentence(rng, lang, 30)))[0] == lang for lang in WORDS for _ in range(20))


def test_features_of_blocks(monkeypatch):
    assert langid.features("1 2 !") is None and langid.features("") is None
    a = langid.features("Ab, ab")
    assert np.isclose(np.linalg.norm(a), 1) and np.allclose(a, langid.features("ab -- AB"))
    assert langid.features("𐐀") is not None


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def listed(spans):
    return ",".join(f"{markov_secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_rows(prose):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base64 = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    parts = [lambda: f'token = "{hexes(40)}"', lambda: "PassWord:  short", lambda: "api_key='" + base64(24), lambda: "AK" + "IA" + hexes(16).upper(),
             lambda: hexes(31), lambda: hexes(64), lambda: "é🎉 ", lambda: "token=secret: abcdefghij", lambda: "apikey==xxxxxxxxxx", lambda: prose(3)]
    rows = [(i, prose(60) + " " + " ".join(rng.choice(parts)() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    return rows, base64


def test_base_spans_equal_re(table, prose, odd):
    rows, base64 = secret_rows(prose)
    many = "x " + " ".join(f"token={i:08d}" for i in range(1500))
    hidden = f"{prose(4)} {base64(44)} é {prose(3)}"
    rows += odd + [(500, many), (501, hidden), (502, "-" * 80 + " " + "=" * 60), (503, "internal_customer_account_identifier getElementByIdentifierName")]
    got = markov_secrets.find_secrets(table(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        options = [brute_spans(t) for t in texts[r.doc_id]]
        assert r.base_sha256 in [hashlib.sha256(listed(s).encode()).hexdigest() for s in options]
        spans = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert ",".join(spans) in map(listed, options)
        assert (r.n_assign, r.n_access, r.n_hex) in [tuple(sum(k == kind for _, k, _ in s) for kind in range(3)) for s in options]
    by_id = {r.doc_id: r for r in got}
    at = hidden.index(hidden.split(" ")[4])
    assert by_id[501].spans == f"markov:{at}:{at + 44}"
    assert by_id[502].spans == by_id[503].spans == ""
    assert markov_secrets.find_secrets(table([])).count() == 0


def test_added_spans_equal_sql(table, prose, odd):
    rows, base64 = secret_rows(prose)
    rows += [(600 + i, f"{prose(30)} é {base64(20 + i)} {prose(9)}-{base64(30)} token={base64(40)}") for i in range(30)] + odd[:4]
    got = markov_secrets.find_secrets(table(rows)).collect()
    assert sum(r.spans.count("markov") for r in got) >= 50
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    want = con.sql(oracle.ORACLE["op8_markov_secrets"]).select("doc_id, n_assign, n_access, n_hex, base_sha256, spans").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def model_file():
    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_twin(raw):
    """The same pieces and scores, declared as a unigram model."""
    at = raw.index(b"\x18\x02\x20", raw.index(b"tok_v0"))
    return raw[:at + 1] + b"\x01" + raw[at + 2:]


SAMPLES = ["", " ", "  two  spaces ", "line\nline\r\n\ttab", "don't 1234.5", "naïve café 漢字 🎉 ▁ x", "a" * 700, "ab" * 300, " " * 77, "=-" * 90, "<s> <unk> <0x0A>"]


def fuzz(n):
    rng = random.Random(9)
    pool = list("aeinorstTH,.!'\"-=#1 0") + ["  ", "\n", "é", "漢", "🎉", "▁", " the", "ing", " "]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_pair_ids_equal_the_library(model_file):
    raw = open(model_file, "rb").read()
    model, library = sp.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in SAMPLES + fuzz(1500):
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        assert ids == library.encode(text), repr(text)
        assert model.decode(ids) == library.decode(ids)
        assert list(model.search("▁" + text.replace(" ", "▁"))) == ids or not text


def best_score(model, text):
    """The best sum of scores over all segmentations; unknown characters cost the least score less ten."""
    best = [0.0] + [-1e30] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in model.scores or end - start == 1:
                best[end] = max(best[end], best[start] + model.scores.get(piece, min(model.scores.values()) - 10))
    return best[-1]


def test_unigram_paths_are_the_best(model_file):
    model = sp.Model(unigram_twin(open(model_file, "rb").read()))
    least = min(model.scores.values()) - 10
    for text in [t for t in SAMPLES if len(t) < 40] + fuzz(60):
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        unknown = sum(c not in model.scores for c in text.replace(" ", "▁"))
        score = sum(model.scores.get(model.texts[i], 0) for i in ids) + unknown * least
        assert score == pytest.approx(best_score(model, "▁" + text.replace(" ", "▁")) if text else 0, rel=1e-12, abs=1e-6)
        assert model.decode(ids) == text.replace("▁", " ")


def test_ids_are_given_out_before_the_end(model_file):
    model = sp.Model(open(model_file, "rb").read())
    path, calls = model._path, []
    model._path = lambda text, back, *ends: calls.append((*ends, len(back))) or path(text, back, *ends)
    text = "▁" + "thequickbrownfoxjumpsoverthelazydog" * 200
    assert len(list(model.search(text))) > 1000
    assert len(calls) > 20 and max(c[-1] for c in calls) < 500


def test_documents_round_trip(table, odd, model_file):
    df = sp.encode_documents(table(odd), model_file)
    rows = df.collect()
    assert len(rows) == len(odd) and all(r.round_trip for r in rows)
    assert sorted(r.n_tokens for r in rows)[:3] == [0, 0, 0] and all(len(r.ids) == r.n_tokens for r in rows)
    texts = [r[0] for r in df.select(sp.decode_ids("ids", model_file)).collect()]
    assert sorted(texts) == sorted(t or "" for _, t in odd)
    assert sp.encode_documents(table([]), model_file).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sp.Model(b"\x0a\x05\x0a\x01x\x18\x04")
