"""The algorithms of the operators against plain versions, without Spark."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skerry.llm import decontaminate, exact_dedup, html_text, minhash, pieces, quality, secrets, substring_dedup, token_files, warc
from skerry.llm.automaton import Scanner


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


# Cuckoo filter


def test_cuckoo_filter_insert_delete_resize():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    index = exact_dedup.LiveIndex()
    for i, k in enumerate(keys):
        index.add(k, i, 1)
    assert all(k in index.filter for k in keys) and index.filter.size == 5000
    assert index.filter.mask > 255  # it had to grow
    index.add(keys[7], 9000, 2)
    assert index.content[keys[7]] == [9000, 3]
    assert index.forget(keys[7]) and keys[7] not in index.content and index.filter.size == 4999
    assert not index.forget(keys[7])


def test_only_ascii_letters_fold():
    assert exact_dedup.key_of("AÉ".encode()) == exact_dedup.key_of("aÉ".encode()) != exact_dedup.key_of("aé".encode())


# Automaton and secrets

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")


def plain_secrets(data: bytes):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(data) if len(m[0]) >= 32]
    return [(secrets.BASE[k], len(data[:s].decode()), len(data[:e].decode())) for s, k, e in sorted(found)]


def test_secrets_like_plain_patterns():
    random.seed(1)
    words = ["password", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "12345678", "AKIA", "ABCDEF12", "deadbeef", "0123456789abcdef", "é", "\n", ".", "passwd", "-"]
    for _ in range(3000):
        data = "".join(random.choices(words, k=random.randint(0, 25))).encode()
        assert [x for x in secrets.find(data) if x[0] in secrets.BASE] == plain_secrets(data)


def test_added_rules():
    assert secrets.find(b"x ghp_" + b"A1" * 15)[0][0] == "github"
    assert secrets.find(b"-----BEGIN RSA PRIVATE KEY-----") == [("private_key", 0, 31)]
    assert secrets.find(b"") == []


def test_all_rules_like_plain_patterns():
    """Every rule, combined in one automaton, finds what its pattern finds alone."""
    random.seed(10)
    words = ["AIza", "sk_live_", "rk_test_", "glpat-", "npm_" + "aB3" * 12, "eyJa1.eyJb2", "eyJ", ".", "a1B2c3D4e5F6", "-", "_", " ", "ghp_", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "AKIA", "é", "token="]
    plain = {k: re.compile(p) for k, (p, _) in secrets.RULES.items() if k != "assign"}
    seen = set()
    for _ in range(4000):
        text = "".join(random.choices(words, k=random.randint(1, 14)))
        got = [x for x in secrets.find(text.encode()) if x[0] in plain]
        names = list(secrets.RULES)
        want = [(m.start(), names.index(k), m.end()) for k, p in plain.items() for m in p.finditer(text) if len(m[0]) >= secrets.RULES[k][1]]
        assert got == [(names[k], a, z) for a, k, z in sorted(want)]
        seen |= {x[0] for x in got}
    assert seen >= {"google", "payment", "gitlab", "npm", "web_token", "github", "slack", "private_key"}


def test_scanner_is_leftmost_longest():
    s = Scanner({"a": "ab*", "b": "(?:ab|abcd)"})
    assert s.scan(b"xabbabcd") == [(1, 0, 4), (1, 1, 3), (4, 0, 6), (4, 1, 8)]


# HTML


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("<nav><a>x</a></nav><article><h1>T</h1><p>a&amp;b<br>c</p><p>  d \n e </article><footer>f</footer>", "T\na&b c\nd e"),
        ("<html><body><div class='sidebar'>side</div><div><h1>Head</h1><p>a long text for all of us to read</p><p>x</p></div></body>", "Head\na long text for all of us to read\nx"),
        ("<article><p>body</p><div class='comments'><p>first!</p></div><form>q</form><script>var p='<p>no</p>'</script></article>", "body"),
        ("<nav><ul><li>x<article><p>unclosed menu before</article>", "unclosed menu before"),
        ("just text", "just text"),
    ],
)
def test_html_main_text(html, text):
    assert html_text.main_text(html) == text


STORY = "A paragraph of some length, with enough words in it to be read as a part of the story."
#: Pages labelled by hand: (page, its main text).
LABELLED = [
    (f'<body><div class="social-policy"><p>{STORY}</p><p>Yes.</p></div><div>x</div></body>', f"{STORY}\nYes."),
    (f'<main><div id="search-engine-history"><p>{STORY}</p></div></main>', STORY),
    (f'<article><p>{STORY}</p></article><div class="reader-remarks"><p>first!</p><p>me too</p></div>', STORY),
    (f"<article><p>{STORY}</p><p>{STORY}</p></article><article class='b'><p>Short.</p></article>", f"{STORY}\n{STORY}\nShort."),
    ("<main class='site-main has-sidebar'><p>text</p></main>", "text"),
    ("<article class='post comments-open'><p>text</p></article>", "text"),
    ("<div class='content no-sidebar'><p>some text</p></div>", "some text"),
    ("<div id='search-results'><article><h1>T</h1><p>some text</p></article></div>", "T\nsome text"),
    (f"<body><div><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div><div>{STORY}</div><div>Short.</div><div>{STORY}</div></body>", f"{STORY}\nShort.\n{STORY}"),
    (f"<body><ul><li><a href=a>one</a><li><a href=b>two</a></ul><div><h2>Head</h2><p>{STORY}<p>Short.<p>{STORY}</div><div class=box><b>Buy</b> <i>now</i></div></body>", f"Head\n{STORY}\nShort.\n{STORY}"),
    (f"<body><h1>Head</h1><div class=text><p>{STORY}</p></div><div class='x-related-links'><p>More</p><p>to read</p></div><div class=comments><p>{STORY}</p></div></body>", f"Head\n{STORY}"),
    (f"<article><div class=lead>Lead.</div><div class=text><p>{STORY}</p></div><section><p>End.</p></section></article>", f"Lead.\n{STORY}\nEnd."),
    ("<nav>menu</nav><div class='ad'>Buy this, it is good.</div><footer>f</footer>", ""),
]


@pytest.mark.parametrize("html, text", LABELLED)
def test_html_labelled_pages(html, text):
    assert html_text.main_text(html) == text


def test_html_ratios_decide(monkeypatch):
    """Without ratios (every line alike) boilerplate without a telling tag or name comes through."""
    monkeypatch.setattr(html_text, "ratios", lambda lines: [1.0] * len(lines))
    wrong = [text for html, text in LABELLED if html_text.main_text(html) != text]
    assert len(wrong) >= 3


def test_html_long_page():
    body = "".join(f"<p>word{i} &lt; {'x ' * (i % 7)}</p>" for i in range(20000))
    text = html_text.main_text(f"<header>h</header><main>{body}</main>")
    assert text.count("\n") == 19999 and text.startswith("word0 <")


# Decontamination


def distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_edits_within_the_budget():
    random.seed(5)
    words = ["thon", "er", "ing", "the", "and", "ble", "ti", "over", "ounds"]
    texts = [" ".join(random.choices(words, k=30)) for _ in range(6)]
    items = decontaminate.Items(list(enumerate(texts)), decontaminate.ERROR)
    for trial in range(40):
        i = trial % 6
        e = decontaminate.budget(len(texts[i]))[0]
        s = list(texts[i])
        for _ in range(random.choice([0, e // 2, e, e + 1, e + 3])):
            p = random.randrange(len(s))
            match random.randrange(3):
                case 0:
                    s[p] = random.choice("abcé")
                case 1:
                    del s[p]
                case 2:
                    s.insert(p, random.choice("xyz"))
        doc = decontaminate.normalised("some words " * (trial % 5) + "".join(s) + " more of them")
        found = {x[1]: x for x in decontaminate.matches(items, ["nothing here", doc]) if x[0] == 1}
        for k, t in enumerate(texts):
            d = distance(t, doc)
            assert (k in found) == (d <= decontaminate.budget(len(t))[0])
            if k in found:
                assert found[k][4] == d == distance(t, doc[found[k][2] : found[k][3]])


# SentencePiece


def test_transducer_is_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = vocabulary("piece_bpe_32k.model")
    model, t = sentencepiece.SentencePieceProcessor(model_file=path), pieces.transducer(path)
    random.seed(2)
    letters = list("abcdehilnorst .,\n\tAEé日😀▁0019=")
    texts = ["", "a", " ", "  a   b ", "x\n\ny", "日本語 text", "▁▁a", "a" * 200, "aaaa " * 20, "\n", "a▁b", "<s> </s> <unk>", "stupid   spaces"]
    texts += ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(800)]
    for text, want, got in zip(texts, model.encode(texts), t.batch(texts), strict=True):
        assert got.tolist() == want
        assert t.decode(want) == model.decode(want)


def field(number: int, data: bytes | int) -> bytes:
    """A field of a protocol-buffer message."""

    def varint(v: int) -> bytes:
        return bytes([v & 127 | (128 if v > 127 else 0)]) + (varint(v >> 7) if v > 127 else b"")

    return varint(number << 3) + varint(data) if isinstance(data, int) else varint(number << 3 | 2) + varint(len(data)) + data


def piece(text: str, score: float, kind: int = 1) -> bytes:
    import struct

    return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + field(3, kind))


def precompiled(rules: dict[str, str]) -> bytes:
    """A character map as the library reads it: a double-array trie of the keys, and their texts."""
    texts, values = b"", {}
    for key, text in rules.items():
        values[key.encode()] = len(texts)
        texts += text.encode() + b"\0"
    children = collections.defaultdict(dict)
    for key in values:
        for i in range(len(key)):
            children[key[:i]][key[i]] = key[: i + 1]
    units, used, bases = {0: 0}, {0}, set()
    queue = [(b"", 0)]
    while queue:
        prefix, at = queue.pop(0)
        labels = sorted(children[prefix]) + ([0] if prefix in values else [])
        base = next(b for b in range(1, 1 << 20) if b not in bases and not any((b ^ c) in used or (b ^ c) == 0 for c in [0, *labels]))
        bases.add(base)
        used |= {base ^ c for c in labels}
        units[at] = units[at] & 0x1FF | (at ^ base) << 10 | (256 if prefix in values else 0)
        for c in sorted(children[prefix]):
            units[base ^ c] = c
            queue.append((children[prefix][c], base ^ c))
        if prefix in values:
            units[base] = values[prefix] | 1 << 31
    size = -(-(max(units) + 256) // 256) * 256
    trie = np.zeros(size, "<u4")
    for at, unit in units.items():
        trie[at] = unit
    return (4 * size).to_bytes(4, "little") + trie.tobytes() + texts


MAP = {"Ａ": "A", "ﬁ": "fi", "\n": " ", "\t": " ", "\u3000": " ", "e\u0301": "é", "\u200b": "", "½": "1/2", "日": "ni", "ab": "ba"}


@pytest.mark.parametrize("kind", ["fold", "map", "map_fold", "user", "user_map"])
def test_normalisers_are_the_library(kind):
    """The public BPE model with other normalisers and symbols, against the library."""
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    if "fold" in kind:
        model += field(3, field(4, 1))
    if "map" in kind:
        model += field(3, field(2, precompiled(MAP)))
    if "user" in kind:
        model += piece("<sep>", 0, 4) + piece("ingx", 0, 4) + piece("日本", 0, 4)
    library, t = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    random.seed(6)
    letters = list("abcdehilnorst .,\n\tAEé日本語😀▁0１") + ["  ", "ingx", "<sep>", "ab", *MAP]
    texts = ["", " ", "  ", "▁", " ▁ a", "a ", "a  b", "Ａ ﬁ", "\u3000a\u3000 b ", "<sep>", " <sep> x", "walking ing", "日本日", "\u200b", "a\u200b b"]
    texts += ["".join(random.choices(letters, k=random.randint(1, 30))) for _ in range(600)]
    for text, got in zip(texts, t.batch(texts), strict=True):
        assert got.tolist() == library.encode(text), text
        assert t.decode(got.tolist()) == library.decode(got.tolist()), text


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_is_the_library(fallback):
    sentencepiece = pytest.importorskip("sentencepiece")
    random.seed(7)
    words = {"".join(random.choices("abcde", k=random.randint(1, 4))) for _ in range(60)} - {"e"}
    words |= {"▁" + w for w in random.sample(sorted(words), 20)} | {"▁", "a", "b"}
    model = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if fallback:
        model += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    model += b"".join(piece(w, -random.uniform(1, 9)) for w in sorted(words)) + piece("dab", 0, 4)
    model += field(2, field(3, 1) + field(35, int(fallback))) + field(3, field(3, 1) + field(4, 1) + field(5, 1))
    library, t = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    texts = ["", "e", "eee", "a  b", "日本", "x y z", "日 本\nab"] + ["".join(random.choices("abcde é日", k=random.randint(1, 25))) for _ in range(800)]
    for text, got in zip(texts, t.batch(texts), strict=True):
        want = library.encode(text)
        assert got.tolist() == want, text
        assert t.decode(want) == library.decode(want), text


def test_workers_let_go_between_stages(monkeypatch):
    """A transducer stays in a worker for the tasks of a stage, and not into a stage of another operator."""
    import types
    import weakref

    from skerry.llm import common

    stage = [1]
    monkeypatch.setattr(common.TaskContext, "get", lambda: types.SimpleNamespace(stageId=lambda: stage[0]))
    path = vocabulary("piece_bpe_32k.model")
    batches = [pa.RecordBatch.from_pydict({"text": ["a b", None]})]
    held = weakref.ref(pieces.transducer(path))
    assert len(list(common.slices(batches))) and held() is pieces.transducer(path)
    stage[0] = 2
    assert len(list(common.slices(batches))) and held() is None


def test_compiled_arcs():
    """Character maps come back from their double array, and arcs of shared prefixes are shared."""
    assert pieces.character_map(precompiled(MAP)) == MAP
    arcs = pieces.Arcs()
    for word, k in (("ab", 1), ("abc", 2), ("b", 3)):
        arcs.add(word, k)
    assert len(arcs.step) == 5 and arcs.longest("abcd", 0) == (3, 2) and arcs.longest("xb", 1) == (2, 3) and arcs.longest("x", 0) == (0, None)


# Token files


def test_encoder_is_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    tk, enc = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["", "Hello, World!", "it's they'LL 123 a1b2", "É́x naïve ﬁ ΣΑΣ İx", "日本語 😀 x\x1cy", "<|endoftext|> a", "...", "a b c", "x" * 3000, "don''t 's", "Thnd*** the&&&"]
    for text, ids in zip(texts, enc.batch(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == tk.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library_on_random_words():
    tokenizers = pytest.importorskip("tokenizers")
    random.seed(3)
    letters = list("aZéßİıŞșÅÆǅŉΣσςÀ1٣!.,'-/ ") + ["\u0301", "\u0307", "e\u0301", "\u00a0", "\u2003", "\u200b", "<|", "'s", "日", "ﬁ", "😀"]
    texts = ["TÜRK DİLİ.", "TARİHİ, ve", "İ", "İ.", "x\u0307.", "ŉ!"] + ["".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(6000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary(name)
        tk, enc = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path)
        assert enc.by_words == (name == "word_bpe_49k.json")
        for text, ids, want in zip(texts, enc.batch(texts), tk.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == want.ids, text


def test_ascii_words_stay_in_arrow(monkeypatch):
    """op3: words of ASCII letters and punctuation are taken apart without a call for each; a column may be a slice."""
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    tk, enc = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["left out", "The cat, THE Cat. cat", None, "", "  (lead) two  spaces\u3000wide.,; ", "a\x1cb c", "end... it's 3rd <|x|>", "Éa été, naïve"]
    column = pa.array(texts, pa.string()).slice(1)
    want = [tk.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    for _ in range(2):  # the second time from the caches
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.batch(column)] == want
    assert enc.batch([]) == [] and enc.batch([None, " "]) == [b"", b""]
    asked = []
    monkeypatch.setattr(token_files.Encoder, "_simple", staticmethod(lambda w: asked.append(w)))
    fresh = token_files.Encoder(path)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in fresh.batch(texts[1:2])] == want[:1] and not asked


def test_tokenizer_calls_are_bounded():
    """op3: many new words go to the tokenizer some at a time, with the same ids."""
    tokenizers = pytest.importorskip("tokenizers")
    random.seed(4)
    words = ["".join(random.choices("abcdeXYZ", k=9)) for _ in range(6000)] + [f"{k}é" for k in range(9000)]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)] + ["", "x" * (token_files.CALL + 5), "a b"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary(name)
        tk, enc, sizes = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path), []

        class Spy:
            def encode_batch_fast(self, texts, add_special_tokens, tk=tk, sizes=sizes):
                sizes.append((sum(map(len, texts)), max(len(w) for t in texts for w in t.split(" "))))
                return tk.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

        enc.tokenizer = Spy()
        want = [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.batch(texts)] == want
        assert all(size <= 1.5 * token_files.CALL or longest > token_files.CALL for size, longest in sizes) and len(sizes) > 3


def test_workers_let_go_of_the_encoder(monkeypatch):
    """op3: the tokenizer and what is cached of it stay for the stage that encodes, not for the one that reads."""
    import types
    import weakref

    from skerry.llm import common

    pytest.importorskip("tokenizers")
    stage = [1]
    monkeypatch.setattr(common.TaskContext, "get", lambda: types.SimpleNamespace(stageId=lambda: stage[0]))
    path = vocabulary("word_bpe_49k.json")
    batches = [pa.RecordBatch.from_pydict({"text": ["a b", None]})]
    held = weakref.ref(token_files.encoder(path))
    assert len(list(common.slices(batches))) and held() is token_files.encoder(path)
    stage[0] = 2
    assert list(token_files._reader(iter([]))) == [] and held() is None


def test_records_notice_damage():
    ids = np.array([5, 6, 2], "<u2").tobytes()
    body = token_files.BODY.pack(9, 3, 2) + ids
    size = len(body).to_bytes(8, "little")
    data = size + token_files.TAIL.pack(token_files.masked(zlib.crc32(size))) + body + token_files.TAIL.pack(token_files.masked(zlib.crc32(body)))
    ((doc, got),) = token_files.records(data, np.array([0]))
    assert (doc, got.tolist()) == (9, [5, 6, 2])
    for at in (0, 14, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.records(bytes(bad), np.array([0])))


# WARC


def test_normaliser_round_trip():
    import io

    payloads = [b"", b"a\r\n\r\nb", bytes(range(256)) * 5000, "é".encode()]
    recs = [warc.record(i, f"http://x/{i}", p, warc.digest(p), None) for i, p in enumerate(payloads)] + [warc.record(9, None, b"", warc.digest(b""), 0)]
    out, idx = io.BytesIO(), io.BytesIO()
    n, size = warc.normalise(io.BytesIO(warc.dump(recs)), out, idx)
    assert (n, size) == (5, len(out.getvalue()))
    for rec, (at, length, _, name) in zip(recs, warc.INDEX.iter_unpack(idx.getvalue()), strict=True):
        assert zlib.decompress(out.getvalue()[at : at + length], 31) == rec
        assert str(__import__("uuid").UUID(bytes=name)).encode() in rec
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(warc.dump([recs[1][:-3]])), io.BytesIO(), io.BytesIO())
    # A payload that inflates a thousandfold, and several members one behind the other.
    big = [warc.record(1, "u", b" " * (8 << 20), warc.digest(b""), None)] * 3
    out, idx = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(warc.dump(big) + warc.dump(recs)), out, idx)[0] == 8
    # Names: copies share one, other payloads of the same page_id do not.
    name = lambda *a: warc.fields(warc.record(*a))[b"WARC-Record-ID"]
    assert name(1, "u", b"a", warc.digest(b"a"), None) != name(1, "u", b"b", warc.digest(b"b"), None)


# Shingles, suffixes


def test_shingle_sets():
    sets = minhash.shingle_sets([b"", b" \t", b"A", b"a", b"a b a b", b"b a", b"x\xc2\xa0y"], 2)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 1, 1]
    assert sets[2].tolist() == sets[3].tolist() and set(sets[5].tolist()) < set(sets[4].tolist())


def test_runs_and_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 300).astype(np.uint64)
    bounds = np.array([0, 30, 30, 64, 120, 155, 300])
    for window in (7, 16, 35):
        prefix = max(1, window - 15)
        g = substring_dedup.sequences(h, prefix)
        want = []
        for d in range(len(bounds) - 1):
            for s in range(bounds[d], bounds[d + 1] - window + 1):
                a = s + int(np.argmin(g[s : s + window - prefix + 1]))
                if want and want[-1][1] == d and want[-1][4] == a:
                    want[-1][3] += 1
                else:
                    want.append([int(g[a]), d, s, 1, a])
        assert list(zip(*(x.tolist() for x in substring_dedup.runs(h, bounds, window, prefix)), strict=True)) == [tuple(x[:4]) for x in want]


def test_repeated_windows():
    random.seed(4)
    for _ in range(100):
        sizes = [random.randint(7, 30) for _ in range(random.randint(1, 8))]
        words = np.array([random.randint(0, 2) for _ in range(sum(sizes))], np.uint64)
        count, starts, at = collections.Counter(), [], 0
        for s in sizes:
            starts += range(at, at + s - 6)
            at += s
        for p in starts:
            count[tuple(words[p : p + 7])] += 1
        want = np.zeros(len(words), bool)
        for p in starts:
            want[p] = count[tuple(words[p : p + 7])] > 1
        assert (substring_dedup.repeated_windows(words, np.array(sizes), 7) == want).all()


def test_deep_nodes():
    """The leaves below each node are exactly the places of one repeated window."""
    random.seed(9)
    sizes = np.array([30, 12, 25, 6, 40])
    words = np.array([random.randint(0, 1) for _ in range(sizes.sum())], np.uint64)
    order, first, last = substring_dedup.deep_nodes(words, sizes, 7)
    got = sorted(sorted(order[a : b + 1].tolist()) for a, b in zip(first, last, strict=True))
    places, at = collections.defaultdict(list), 0
    for s in sizes.tolist():
        for p in range(at, at + s - 6):
            places[tuple(words[p : p + 7])].append(p)
        at += s
    assert got == sorted(v for v in places.values() if len(v) > 1)
    assert all(len(x) == 0 for x in substring_dedup.deep_nodes(words[:5], np.array([5]), 7))


# Quality


def test_isotonic_is_monotone():
    x, y = quality.isotonic([0.1, 0.2, 0.3, 0.4], [0, 1, 0, 1], [10, 10, 10, 10])
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and len(x) == 3


def test_statistics_of_any_text():
    for text in (b"", b" \n", b"a", "é😀".encode(), b"the the the\nthe the the\n" * 10000, bytes(range(256))):
        stats = quality.statistics(text)
        assert len(stats) == quality.N_STATS and all(np.isfinite(stats))
