"""Content identities as column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import canonical

NUL = "\0"
# Fixed value: the method's name in identities.
COMMAND = "local_command_json"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 over the parts, each followed by NUL."""
    joined = F.concat(*(x for p in parts for x in (_col(p), F.lit(NUL))))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def source_id(kind: Column | str, root: Column | str) -> Column:
    return stable_id("src", kind, root)


def item_id(source: Column | str, relative_path: Column | str) -> Column:
    return stable_id("item", source, relative_path)


def queue_id(item: Column | str, digest: Column | str) -> Column:
    return stable_id("queue", item, digest)


def approval_digest(media: Column | str, sidecar: Column | str) -> Column:
    """One digest over the media's digest and its sidecar's, or the sidecar's absence."""
    media, sidecar = _col(media), _col(sidecar)
    tail = F.when(sidecar.isNotNull(), F.concat(F.lit(f"transcript-sidecar{NUL}"), sidecar)).otherwise(F.lit("transcript-sidecar-absent"))
    return F.sha2(F.concat(F.lit(f"media{NUL}"), media, F.lit(NUL), tail), 256)


def sidecar_identity(raw_digest: Column | str, method: str = "sidecar") -> Column:
    """Identity of a transcript taken from a sidecar: its method and the digest of its raw bytes, as canonical JSON."""
    text = F.concat(F.lit(f'{{"method":"{method}","transcript_sha256":"'), _col(raw_digest), F.lit('"}'))
    return F.sha2(text, 256)


def command_digest(argv: Sequence[str]) -> str:
    """Digest of a transcriber's command line."""
    return hashlib.sha256(json.dumps({"method": COMMAND, "argv": list(argv)}, sort_keys=True).encode()).hexdigest()


def command_identity(argv: Sequence[str], transcript: Column) -> Column:
    """Identity of a transcript that a command gave: the command line and the struct (text, segments), as canonical JSON."""
    said = F.sha2(canonical(F.to_json(transcript, {"ignoreNullFields": "false"}), compact=False), 256)
    return F.sha2(F.concat(F.lit(f'{{"command_sha256":"{command_digest(argv)}","method":"{COMMAND}","transcript_sha256":"'), said, F.lit('"}')), 256)


def slug(name: Column | str) -> Column:
    """Lower-case letters and digits, other runs as one hyphen, no hyphen at the ends; `bundle` if nothing is left."""
    joined = F.regexp_replace(F.lower(_col(name)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.btrim(joined, F.lit("-")), F.lit("")), F.lit("bundle"))


def bundle_id(stem: Column | str, media: Column | str, transcript: Column | str) -> Column:
    """slug-hash: the name and 12 hex digits over media digest and transcript identity."""
    joined = F.concat(_col(media), F.lit(NUL), _col(transcript), F.lit(NUL))
    return F.concat(slug(stem), F.lit("-"), F.substring(F.sha2(joined, 256), 1, 12))
