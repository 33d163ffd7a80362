"""Masking takes the whole of a private key, not its header line only."""

import base64
import random

from quakeloom.llm import secret_scans
from tests.llm.helpers import documents


def test_no_byte_of_a_key_is_left(spark):
    body = base64.b64encode(random.Random(1).randbytes(600)).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    assert len(lines[-1]) < 64
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = [begin, *lines, end]
    rows = [
        "\n".join(key), "\r\n".join(key), "\\n".join(key), " ".join(key), "".join(key), "\n> ".join(key), "\n    ".join(key),
        "\n".join(key[:-1]), "\n".join([begin, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123", "", *lines, end]), "\n".join([begin, *lines[:-1], "Qx", end]), "\n".join([begin, *lines[:-1], "Qx"]),
    ]
    got = {r.doc_id: r for r in secret_scans.redact(documents(spark, [(i, f"before it\n{t}\nand after it") for i, t in enumerate(rows)])).collect()}
    for i in range(len(rows)):
        assert got[i].text == "before it\n-----BEGIN [SECRET]\nand after it" and got[i].n_chars == len(got[i].text), (i, got[i].text)


def test_text_after_a_header_stays(spark):
    text = "-----BEGIN PRIVATE KEY-----\nis how such files begin.\nMore text"
    assert secret_scans.redact(documents(spark, [(1, text)])).first().text == text.replace("PRIVATE KEY-----", "[SECRET]")
