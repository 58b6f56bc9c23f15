import time

import pytest

from acctlens.llm.secret_scan import find_secrets, redacted

BODY = "\n".join("MIIEpAIBAAKCAQEA" * 4 for _ in range(20))


def cut(text):
    return redacted(text, ",".join(f"{k}:{a}:{b}" for k, a, b in find_secrets(text)))


@pytest.mark.parametrize("user, word", [(3, 200), (100, 5), (5000, 5000)])
def test_long_logins(user, word):
    assert cut(f"see ftp://{'u' * user}:{'z' * word}@host/x") == "see [secret]host/x"


@pytest.mark.parametrize("label, head", [
    ("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n"),
    ("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2\nComment: a - b\n\n"), ("PRIVATE KEY", "")])
def test_whole_keys(label, head):
    key = f"-----BEGIN {label}-----\n{head}{BODY}"
    assert cut(f"a\n{key}\n-----END {label}-----\nb") == "a\n[secret]\nb"
    # Without its end, the key's body goes and the rest stays.
    assert cut(f"a\n{key}\n- b") == "a\n[secret]- b"
    assert cut(f"{key}\n-----BEGIN CERTIFICATE-----\nc") == "[secret]-----BEGIN CERTIFICATE-----\nc"


def test_many_open_keys_are_passed_once():
    began = time.process_time()
    find_secrets("-----BEGIN PRIVATE KEY-----, " * 50_000)
    assert time.process_time() - began < 10
