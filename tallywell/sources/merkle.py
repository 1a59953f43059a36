"""Fingerprints of builds, locks and data: Merkle trees over files and their chunks.

A tree's root changes with any byte of any file. A proof shows that one file
belongs to a root without the others; two trees tell which files differ.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Mapping, Sequence

from tallywell.sources import files

#: Bytes of a chunk; a larger file is a tree of chunks, which tasks hash one by one.
CHUNK = 64 << 20


class FingerprintError(RuntimeError):
    pass


def _leaf(digest: str) -> str:
    return hashlib.sha256(b"\0" + bytes.fromhex(digest)).hexdigest()


def _node(left: str, right: str) -> str:
    return hashlib.sha256(b"\1" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def _levels(digests: Sequence[str]) -> list[list[str]]:
    """Leaves first, the root last; a node without a partner goes up as it is."""
    level = [_leaf(d) for d in digests] or [hashlib.sha256(b"").hexdigest()]
    out = [level]
    while len(level) > 1:
        level = [_node(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        out.append(level)
    return out


def root_of(digests: Sequence[str]) -> str:
    """Root over SHA-256 digests in their order."""
    return _levels(digests)[-1][0]


def proof(digests: Sequence[str], k: int) -> list[tuple[bool, str]]:
    """What is needed beside the k-th digest to get the root: (stands to the right, node) from the leaf up."""
    out = []
    for level in _levels(digests)[:-1]:
        other = k ^ 1
        if other < len(level):
            out.append((other > k, level[other]))
        k //= 2
    return out


def proves(digest: str, steps: Sequence[tuple[bool, str]], root: str) -> bool:
    found = _leaf(digest)
    for right, node in steps:
        found = _node(found, node) if right else _node(node, found)
    return found == root


def named_leaf(name: str, digest: str) -> str:
    """A file's digest with its name, so that moved files differ."""
    return hashlib.sha256(name.encode() + b"\0" + bytes.fromhex(digest)).hexdigest()


def file_digests(folder: str, names: Sequence[str] | None = None, chunk: int | None = None) -> dict[str, str]:
    """A digest of each file below ``folder``: SHA-256 if it is one chunk, else the root over its chunks. Tasks read the bytes."""
    width = chunk or CHUNK
    sizes = dict(files.list_files(folder))
    names = sorted(sizes) if names is None else list(names)
    if missing := [n for n in names if n not in sizes]:
        raise FingerprintError(f"missing: {', '.join(missing)}")
    asked = [f"{n}\n{at}\n{min(width, sizes[n] - at)}" for n in names for at in range(0, max(1, sizes[n]), width)]

    def run(ask: str) -> str:
        name, at, n = ask.rsplit("\n", 2)
        s, path = files.store(f"{folder}/{name}")
        h, at, left = hashlib.sha256(), int(at), int(n)
        with s.open_input_file(path) as f:
            while left:
                data = f.read_at(min(1 << 20, left), at)
                if not data:
                    raise FingerprintError(f"{name} ended while it was read")
                h.update(data)
                at, left = at + len(data), left - len(data)
        return h.hexdigest()

    found = files.of_each(asked, run)
    chunks: dict[str, list[str]] = {}
    for ask in asked:
        chunks.setdefault(ask.rsplit("\n", 2)[0], []).append(found[ask])
    return {n: c[0] if len(c) == 1 else root_of(c) for n, c in chunks.items()}


def tree(folder: str, names: Sequence[str] | None = None, chunk: int | None = None) -> dict:
    """{root, files: {name: digest}} of the files below ``folder``."""
    found = dict(sorted(file_digests(folder, names, chunk).items()))
    return {"root": root_of([named_leaf(n, d) for n, d in found.items()]), "files": found}


def changed(before: Mapping, after: Mapping) -> dict[str, str]:
    """name -> added, removed or changed, of two trees."""
    a, b = before["files"], after["files"]
    return {n: "added" if n not in a else "removed" if n not in b else "changed" for n in sorted(a.keys() | b.keys()) if a.get(n) != b.get(n)}


def prove_file(whole: Mapping, name: str) -> list[tuple[bool, str]]:
    """The steps from one file of a tree to its root."""
    names = list(whole["files"])
    return proof([named_leaf(n, d) for n, d in whole["files"].items()], names.index(name))


def file_is_in(name: str, digest: str, steps: Sequence[tuple[bool, str]], root: str) -> bool:
    return proves(named_leaf(name, digest), steps, root)


# -- builds ------------------------------------------------------------------

def dirty(folder: str) -> str:
    """true, false, or unknown with the reason: never clean by default."""
    if not files.exists(f"{folder}/.git"):
        return "unknown(no-git-repo)"
    try:
        out = subprocess.run(["git", "status", "--porcelain"], cwd=folder, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return "unknown(git-unavailable)"
    if out.returncode:
        return f"unknown(git-exit-{out.returncode})"
    return "true" if out.stdout.strip() else "false"


def build(folder: str, code: Sequence[str], lock: str) -> dict:
    """build, dependencies (the lock's SHA-256) and dirty of a source tree; ``code`` are the folders that count.

    A missing lock or folder raises: a fingerprint never leaves its inputs out.
    """
    folder = folder.rstrip("/")
    if not files.exists(f"{folder}/{lock}"):
        raise FingerprintError(f"the lock is missing: {folder}/{lock}")
    if missing := [c for c in code if not files.exists(f"{folder}/{c}")]:
        raise FingerprintError(f"missing: {', '.join(missing)}")
    names = [f"{c}/{n}" for c in code for n, _ in files.list_files(f"{folder}/{c}") if "__pycache__" not in n.split("/")]
    whole = tree(folder, [*names, lock])
    return {"build": whole["root"], "dependencies": files.digests(folder, [lock])[lock], "dirty": dirty(folder), "files": whole["files"]}
