import io
import json
import zipfile

import pytest

from lodestone.config import Settings
from lodestone.sources.files import load_chunks, parse_files, read_files, unsupported, uploads
from lodestone.sources.ocr import VisionChatOCR, ocr_provider
from lodestone.sources.parsers import page_blocks, parse


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_plain_formats():
    assert parse("a.txt", "één\r\ntwo\rthree".encode()) == "één\ntwo\nthree"
    assert parse("a.md", "汉字".encode("gbk")) == "汉字"
    assert parse("a.txt", b"\xff\xfe\xfa") is not None
    assert parse("a.csv", b"a;b; c\n1;;2\n\n") == "a | b | c\n1 | 2"
    assert parse("a.json", b'{"b":1.0,"a":"\xc3\xa9"}') == '{\n  "b": 1.0,\n  "a": "é"\n}'
    assert parse("a.jsonl", b'{"a": 1}\n\n{"b":2}') == '{"a": 1}\n{"b": 2}'
    assert parse("a.jsonl", b'{"a": 1}') == json.dumps({"a": 1}, indent=2)
    assert parse("a.json", b"{broken") == "{broken"
    assert parse("a.xml", b"<r><a> x </a><b/>y</r>") == "x\ny"
    assert parse("a.xml", b"<r>x<br>y</r>").split() == ["x", "y"]
    assert parse("a.html", b"<p>a &amp; b</p><!-- no --><script>s()</script>") == "a & b\ns()"
    assert parse("a.rtf", rb"{\rtf1 hello\'e9 \b bold}").split() == ["hello", "bold"]


def test_zipped_formats():
    word = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert parse("a.docx", packed({"word/document.xml": word})) == "one\na | b"
    sheet = '<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    shared = "<sst><si><t> </t></si><si><t>two</t></si></sst>"
    assert parse("a.xlsx", packed({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet})) == "two | 5\nin"
    slides = {f"ppt/slides/slide{i}.xml": f"<s><t>{i}</t></s>" for i in (2, 10)}
    assert parse("a.pptx", packed(slides)) == "10\n2"
    assert parse("a.pptx", packed({"other.xml": "<a>x</a>"})) == ""
    assert parse("a.odt", packed({"content.xml": "<c>text</c>", "meta.xml": "<m>no</m>"})) == "text"
    assert parse("a.epub", packed({"b.xhtml": "<p>b</p>", "a.html": "<p>a<br>c", "x.css": "no"})) == "b\na\nc"


def test_refused():
    for name in ("a.doc", "a.xls", "a.ppt", "a.zip", "noext", "a.png"):
        with pytest.raises(ValueError):
            parse(name, b"")


def test_ocr():
    calls = []

    def chat(messages):
        calls.append(messages)
        if len(calls) == 1:
            raise OSError("busy")
        return " read "

    assert parse("a.png", b"x", ocr_provider("Qwen", chat)) == "read"
    assert calls[0][0]["content"][0]["image_url"]["url"] == "data:image/png;base64,eA=="
    with pytest.raises(ValueError):
        ocr_provider("none", chat)
    with pytest.raises(OSError):
        VisionChatOCR(lambda m: (_ for _ in ()).throw(OSError())).extract_image_bytes(b"", "image/png")
    assert page_blocks(["a", "", "b"]) == "[第 1 页]\na\n\n[第 3 页]\nb"


def test_load(spark, tmp_path):
    (tmp_path / "one.txt").write_text("alpha beta\n\n" + "long words here. " * 100)
    (tmp_path / "two.txt").write_text("alpha  beta\n\nnew")
    files = read_files(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")])
    settings = Settings(chunk_strategy="token", chunk_size=3, chunk_overlap=0)
    every, kept = load_chunks(files, settings)
    rows = kept.orderBy("file_no", "chunk_index").collect()
    assert len({r["content_hash"] for r in rows}) == len(rows) < every.count()
    assert {r["source"] for r in rows} <= {"one.txt", "two.txt"}
    _, named = load_chunks(files, settings, names=["A"])
    assert {r["source"] for r in named.collect()} == {"A"}
    with pytest.raises(ValueError):
        read_files(spark, [])


def test_errors(spark):
    files = uploads(spark, [("ok.txt", b"fine"), ("bad.docx", b"not a zip"), ("x.zip", b"")])
    got = {r["source"]: r for r in parse_files(files, Settings()).collect()}
    assert got["ok.txt"]["text"] == "fine" and got["bad.docx"]["error"] and "unsupported" in got["x.zip"]["error"]
    assert [r["source"] for r in unsupported(files).collect()] == ["x.zip"]
    with pytest.raises(ValueError):
        load_chunks(files, Settings())
    with pytest.raises(Exception, match="bad.docx"):
        load_chunks(uploads(spark, [("bad.docx", b"no")]), Settings())[1].collect()
