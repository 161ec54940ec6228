"""Sample files with planted tokens, one of each template for each row of `supplier`, as SQL that Spark and DuckDB both run.

In the templates k is the row's key as text, h and g are 32 lower-case hexadecimal digits that follow from it, and n is
a line feed.
"""

from __future__ import annotations

import hashlib
import zlib

#: (path, text) as SQL expressions over k, h, g, n.
TOKENS: tuple[tuple[str, str], ...] = (
    ("'src/url' || k || '.txt'", "'see https://user:' || substr(h, 1, 16) || '@host.example/x and ftp://a1b2:' || substr(g, 1, 12) || '@files.example'"),
    ("'src/jwt' || k || '.txt'", "'xeyJ' || h || '.' || g || ' eyJ' || h || '.' || g || '.' || substr(h, 3, 9)"),
    ("'src/github' || k || '.txt'", "'ghp_' || h || substr(g, 1, 4) || ' gho_' || substr(h, 1, 30)"),
    ("'src/gitlab' || k || '.txt'", "'glpat-' || substr(h, 1, 20) || ' glpat-' || substr(h, 1, 19)"),
    ("'src/stripe' || k || '.txt'", "'sk_live_' || substr(h, 1, 24) || ' rk_live_' || substr(g, 1, 23)"),
    ("'src/square' || k || '.txt'", "'sq0idp-' || substr(h, 1, 22) || ' EAAA' || h || substr(g, 1, 28)"),
    ("'src/azure' || k || '.txt'", "'AccountKey=' || h || g || substr(h, 1, 24) || ' ' || 'azure client secret = ' || substr(g, 1, 32) || substr(h, 1, 4)"),
    ("'src/gcp' || k || '.txt'", "'AIzaSy' || h || 'x'"),
    ("'src/npm' || k || '.txt'", "'npm_' || h || substr(g, 1, 4) || n || '//registry.example/:_authToken=' || h"),
    ("'src/slack' || k || '.txt'", "'xoxb-123-45-' || h || ' https://hooks.slack.com/services/T' || substr(h, 1, 8) || '/B' || substr(g, 1, 8) || '/' || h"),
    ("'src/mail' || k || '.txt'", "'SG.' || substr(h, 1, 22) || '.' || g || substr(h, 1, 11) || ' ' || h || '-us12 AC' || g || ' SK' || h"),
    ("'src/intra' || k || '.txt'", "'s-s4t2ud-' || h || g || ' PuTTY-User-Key-File-2: ssh-rsa AGE-SECRET-KEY-1' || upper(h || substr(g, 1, 26))"),
    ("'src/pem' || k || '.txt'", "'-----BEGIN RSA PRIVATE KEY-----' || n || h || g || n || '-----END RSA PRIVATE KEY-----'"),
    ("'src/pemline' || k || '.txt'", "'-----BEGIN EC PRIVATE KEY-----' || h || g || h || '-----END EC PRIVATE KEY----- -----BEGIN CERTIFICATE REQUEST-----' || h || g || h || '-----END CERTIFICATE REQUEST-----'"),
    ("'src/ssh' || k || '.txt'", "'ssh-ed25519 ' || h || g || h || substr(g, 1, 8) || '= me@host'"),
    ("'src/llm' || k || '.txt'", "'sk-proj-' || h || substr(g, 1, 12) || ' sk-' || h || substr(g, 1, 12) || ' sk-ant-api03-' || h || g || ' hf_' || h || 'abcde co.' || h || ' r8_' || h || substr(g, 1, 8)"),
    ("'src/uuid' || k || '.txt'", "'id ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"),
    ("'src/aws' || k || '.txt'", "'AKIA' || upper(substr(h, 1, 16)) || ' aws_secret_access_key = ' || h || substr(g, 1, 8)"),
    ("'src/dbs' || k || '.txt'", "'postgresql://u:' || h || '@db/x postgres://u:' || g || '@db/y mongodb+srv://u:' || h || '@c/z mongodb://u:pw@c mysql://root:' || substr(g, 1, 9) || '@m'"),
    ("'src/generic' || k || '.txt'", "'api_key = \"' || h || '\", token: ' || g || ' password := correct_horse_battery auth=short'"),
    ("'src/words' || k || '.txt'", "'secret_name = PROJECT_NAME_ALIAS_VALUE' || n || 'token = API_KEY_CONSTANT_OF_MODULE' || n || 'key = ' || upper(substr(g, 1, 18)) || n || 'key=' || repeat('ab', 20)"),
    ("'src/accent' || k || '.txt'", "'é ñ clé token = ' || h || ' ß, пароль password=' || g"),
)

IGNORED: tuple[tuple[str, str], ...] = (
    ("'src/ignore' || k || '.txt'", "'token = ' || h || ' # scan:ignore' || n || 'token = ' || g || n || 'DEMO_KEY_ token = ' || h || n || 'FAKE_token = ' || g"),
    ("'src/next' || k || '.txt'", "'// scan:ignore-next' || n || 'token = ' || h || n || 'token = ' || g || n || '# scan:ignore-next' || n || '# scan:ignore-next' || n || 'key = ' || h"),
    ("'src/attr' || k || '.rs'", "'#[test]' || n || 'token = ' || h || n || '  it(\"key = ' || g || '\", x)' || n || '#[tokio::test] key = ' || h"),
    ("'src/crlf' || k || '.txt'", "'token = ' || h || chr(13) || n || chr(13) || n || n || 'key = ' || g || n"),
)

BLOCKS: tuple[tuple[str, str], ...] = (
    ("'src/block' || k || '.rs'", "'const A: &str = \"key\";' || n || n || '#[test]' || n || 'fn t() {' || n || '    token = ' || h || n || '    x();' || n || '}' || n || n || 'token = ' || g"),
    ("'src/block' || k || '.ts'", "'const a = 1;' || n || n || 'describe(\"x\", () => {' || n || '  it(\"y\", () => {' || n || '    token = ' || h || n || '  });' || n || '});' || n || n || 'token = ' || g"),
    ("'src/block' || k || '.py'", "'a = 1' || n || n || 'def test_x():' || n || '    token = \"' || h || '\"' || n || '    assert True' || n || n || 'token = \"' || g || '\"'"),
    ("'src/open' || k || '.rs'", "'#[test]' || n || 'fn t() {' || n || 'token = ' || h || n || 'key = ' || g"),
)


def files_sql(*groups: tuple[tuple[str, str], ...]) -> str:
    """A DuckDB query of (path, text) over the view supplier."""
    parts = [f"SELECT {p} AS path, {t} AS text FROM seeds" for g in groups for p, t in g]
    seeds = "SELECT cast(s_suppkey AS string) AS k, md5(cast(s_suppkey AS string)) AS h, md5('g' || cast(s_suppkey AS string)) AS g, chr(10) AS n FROM supplier"
    return f"WITH seeds AS ({seeds}) " + " UNION ALL ".join(parts)


def repository_files(before: dict[str, bytes], now: dict[str, bytes]) -> dict[str, bytes]:
    """The files of a repository's folder whose last commit holds the paths `before`, with `now` staged."""
    out: dict[str, bytes] = {}

    def keep(kind: str, body: bytes) -> bytes:
        whole = f"{kind} {len(body)}".encode() + b"\0" + body
        oid = hashlib.sha1(whole, usedforsecurity=False)
        out[f".git/objects/{oid.hexdigest()[:2]}/{oid.hexdigest()[2:]}"] = zlib.compress(whole)
        return oid.digest()

    def tree(files: dict[str, bytes]) -> bytes:
        own = {name: (b"100644", keep("blob", body)) for name, body in files.items() if "/" not in name}
        for folder in {name.split("/", 1)[0] for name in files if "/" in name}:
            own[folder] = (b"40000", tree({n.split("/", 1)[1]: b for n, b in files.items() if n.startswith(f"{folder}/")}))
        return keep("tree", b"".join(mode + b" " + name.encode() + b"\0" + oid for name, (mode, oid) in sorted(own.items())))

    commit = keep("commit", b"tree " + tree(before).hex().encode() + b"\nauthor a <a> 0 +0000\n\nx\n")
    index = b"DIRC" + (2).to_bytes(4, "big") + len(now).to_bytes(4, "big")
    for name, body in sorted(now.items()):
        raw = bytes(24) + (0o100644).to_bytes(4, "big") + bytes(12) + keep("blob", body) + min(len(name), 0xFFF).to_bytes(2, "big") + name.encode()
        index += raw + bytes(8 - len(raw) % 8)
    return out | now | {".git/HEAD": b"ref: refs/heads/main\n", ".git/refs/heads/main": commit.hex().encode() + b"\n", ".git/index": index}
