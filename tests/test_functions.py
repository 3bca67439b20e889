import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone.config import Settings, chunk_strategy, read_env_file, usable
from lodestone.engine import mask_text
from lodestone.functions import pii
from lodestone.functions.chunking import SEPARATORS, chunk_documents, split_chars, split_tokens
from lodestone.functions.text import basename, clean_text, cleaned, content_hash, estimate_tokens, extension, extract_json, strip

PARTS = ["a", "Bc", "12", " ", "  ", "\t", "\n", "\n\n\n", "\x00", "\x0b", "\x0c", "\x1d", "\x7f", "　", "\xa0", "汉", "字", "é", "🙂", "_", ".", "!", "１２", " ", "abcdefghijk"]


def strings(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def apply(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r) for r in df.select("i", *columns).orderBy("i").drop("i").collect()]


def test_text_functions(spark):
    texts = strings()
    got = apply(spark, texts, clean_text("t"), content_hash("t"), strip("t"), estimate_tokens("t"))
    for t, (clean, digest, stripped, tokens) in zip(texts, got, strict=True):
        want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t))).strip()
        assert clean == cleaned(t) == want
        assert digest == hashlib.md5(re.sub(r"\s+", "", t).encode()).hexdigest()
        assert stripped == t.strip()
        han = sum("一" <= c <= "鿿" for c in t)
        assert tokens == (han + (len(t) - han) // 4 + 1 if t else 0)


def test_null_text(spark):
    assert apply(spark, [None], clean_text("t"), estimate_tokens("t")) == [("", 0)]


def test_json_and_paths(spark):
    said = ['so: {"a": {"b": 1}} yes', "{broken", "none", '{"a": 1} and {"b": 2}', None]
    assert [r[0] for r in apply(spark, said, extract_json("t"))] == ['{"a": {"b": 1}}', None, None, None, None]
    got = apply(spark, ["/x/y.TXT", "a.tar.gz", "noext", "/d.e/f", ".hidden"], extension("t"), basename("t"))
    assert got == [(".txt", "y.TXT"), (".gz", "a.tar.gz"), ("", "noext"), ("", "f"), ("", ".hidden")]


def test_pii(spark):
    runs = ["1" * n for n in range(10, 22)] + ["13812345678", "a13812345678,13912345678", "1" * 17 + "X", "1" * 17 + "x9", "me@x.org", "13812345678@mail.com", "１３８１２３４５６７８", "no", ""]
    texts = runs + [f"x {a} y {b}" for a in runs[:6] for b in runs[-6:]]
    got = apply(spark, texts, pii.mask(F.col("t")), pii.hits(F.col("t")))
    assert got == [mask_text(t) for t in texts]
    assert mask_text("1" * 18)[0] == "[ID_CARD]" and mask_text("1" * 19)[0] == "[BANK_CARD]" and mask_text("1" * 20)[1] == 0
    assert apply(spark, ["13812345678"], pii.mask(F.col("t"), enabled=False)) == [("13812345678",)]
    history = spark.sql("select array(struct('user' as role, 'call 13812345678' as content)) as h")
    assert history.select(pii.mask_history(F.col("h"))).first()[0][0]["content"] == "call [PHONE]"


def units(text):
    out = []
    for part in re.findall(r"\s+|[一-鿿]|[A-Za-z0-9_]+|\S", text):
        out += [part[i : i + 4] for i in range(0, len(part), 4)] if re.fullmatch("[A-Za-z0-9_]+", part) else [part]
    return out


def test_token_chunks(spark):
    texts = strings(200, 2)
    for size, overlap in ((5, 2), (8, 0), (1, 0), (3, 9), (4, -2), (6, 2), (12, 4), (40, 30)):
        step = size - max(0, min(overlap, size - 1))
        got = apply(spark, texts, split_tokens(F.col("t"), size, overlap))
        for t, (chunks,) in zip(texts, got, strict=True):
            u, want, at = units(t), [], 0
            while at < len(u):
                want.append("".join(u[at : at + size]).strip())
                if at + size >= len(u):
                    break
                at += step
            assert chunks == [w for w in want if w], (t, size, overlap)


def test_char_chunks():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n", "\n\n", "汉字。", "x" * 30, "? "]) for _ in range(rng.randrange(1, 60)))
        size, overlap = rng.choice([(40, 10), (80, 0), (25, 24)])
        chunks = split_chars(text, size, overlap, SEPARATORS)
        assert all(len(c) <= size for c in chunks)
        assert set("".join(chunks)) >= set(text) - set(" \n")
        at = 0
        for c in chunks:  # in order
            at = text.index(c, at if overlap == 0 else max(0, at - size))
    assert split_chars("short", 100, 10) == ["short"] and split_chars("", 10, 2) == []


def split_plainly(text, size, overlap, marks):
    """The splitter's description, written down without its code: a list of pieces by the first mark present, each with the
    mark before it; pieces of at least `size` are split further; runs of shorter ones are joined while they fit, and a
    chunk starts with the longest tail of the one before that is at most `overlap` long and leaves room."""
    mark = next((m for m in marks if m and m in text), "")
    weaker = marks[marks.index(mark) + 1 :] if mark in marks else ()
    if mark:
        pieces, at = [], 0
        for m in re.finditer(re.escape(mark), text):
            if m.start() > at:
                pieces.append(text[at : m.start()])
            at = m.start()
        pieces.append(text[at:])
    else:
        pieces = list(text)
    out, run = [], []

    def close():
        if not run:
            return
        window = [run[0]]
        for p in run[1:]:
            if len("".join(window)) + len(p) > size:
                out.append("".join(window).strip())
                while window and (len("".join(window)) > overlap or len("".join(window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        out.append("".join(window).strip())
        run.clear()

    for p in pieces:
        if len(p) < size:
            run.append(p)
        else:
            close()
            out.extend(split_plainly(p, size, overlap, weaker) if weaker else [p])
    close()
    return [c for c in out if c]


def test_char_chunks_by_another_splitter():
    rng = random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n", "\n\n", "汉字。", "x" * 30, "? ", "!", "；", ". "]) for _ in range(rng.randrange(60)))
        for size, overlap in ((40, 10), (80, 0), (25, 24), (7, 3), (1, 0)):
            assert split_chars(text, size, overlap, SEPARATORS) == split_plainly(text, size, overlap, SEPARATORS), (text, size, overlap)


def test_char_chunks_of_documents(spark):
    import pyarrow.parquet as pq

    from lodestone.plans.catalog import QUERIES
    from tests.conftest import DATA

    want = set()
    for r in pq.read_table(f"{DATA}/sf0.001/documents.parquet").to_pylist():
        cleaned = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", r["text"]))).strip()
        want |= {(r["doc_id"], i, c.strip()) for i, c in enumerate(split_plainly(cleaned, 800, 150, SEPARATORS)) if c.strip()}
    assert {(r["doc_id"], r["chunk_index"], r["text"]) for r in QUERIES["chunk_char"](spark, f"{DATA}/sf0.001").collect()} == want


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text('# note\nTOP_K=9\nexport LLM_MODEL="m # x"\nCHUNK_SIZE = 50 # why\nOCR_MODEL=\nno line\nCOLLECTION_NAME=\'kb\'\n', encoding="utf-8")
    s = Settings.from_env({"chunk_size": "60"}, tmp_path / ".env")
    assert (s.top_k, s.llm_model, s.chunk_size, s.ocr_model, s.collection_name) == (9, "m # x", 60, "", "kb")
    assert read_env_file(tmp_path / "none") == {} and Settings.from_env({}, None).top_k == 5


def test_logger(capsys):
    import logging

    from lodestone.log import get_logger

    log = get_logger("lodestone.test")
    assert get_logger("lodestone.test") is log and len(log.handlers) == 1 and log.level == logging.INFO and not log.propagate


def test_settings():
    s = Settings.from_env({"TOP_K": "7", "enable_ocr": "true", "OPENAI_BASE_URL": "https://api.deepseek.com", "DEEPSEEK_API_KEY": "k1", "OPENAI_API_KEY": "k2"})
    assert (s.top_k, s.enable_ocr, s.llm_api_key, s.ocr_key) == (7, True, "k1", "k2")
    assert [usable(x) for x in ("sk-your-key-here", " YOUR-x ", "", None, " ", "sk-xxxx", "你的 API key", " real ", "my-your-key2")] == [""] * 7 + ["real", "my-your-key2"]
    assert Settings(openai_base_url="https://dashscope.x", openai_api_key="o", dashscope_api_key="d", deepseek_api_key="p").llm_api_key == "d"
    assert Settings(openai_base_url="https://a.deepseek.aliyuncs.com", openai_api_key="o", dashscope_api_key="d").llm_api_key == "d"
    assert Settings(openai_base_url="", dashscope_api_key="d", deepseek_api_key="p").llm_api_key == "p" and Settings().llm_api_key == ""
    assert Settings(ocr_api_key="your-key", dashscope_api_key="d", openai_api_key="o").ocr_key == "d"
    assert [chunk_strategy(x) for x in ("Recursive", "TOKENS", "other", None)] == ["char", "token", "char", "char"]
    assert Settings().resolve_chunking(0, None) == (800, 150) and Settings().resolve_chunking(10, 0) == (10, 0)
    assert Settings(enable_ocr=True).check_ocr()[1] == 1 and Settings().check_ocr()[1] == 0


def test_token_chunks_clean_each_text_once(spark):
    """A filter on the cleaned text would be worked out beside the cleaned text itself."""
    docs = spark.createDataFrame([(1, "s", " a\tb ")], "doc_id long, source string, text string")
    plan = chunk_documents(docs, 200, 40, "token", keep=("doc_id",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("btrim") + plan.count("trim(both") <= 2 and "Filter" not in plan.replace("Filter (size", "")
    assert plan.count("{3,}") == 1


def test_every_white_space_is_stripped(spark):
    marks = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c]
    got = apply(spark, [c + "a" + c for c in marks], strip("t"), content_hash("t"))
    for c, (stripped, digest) in zip(marks, got, strict=True):
        assert stripped == (c + "a" + c).strip()
        assert digest == hashlib.md5(stripped.encode()).hexdigest()
