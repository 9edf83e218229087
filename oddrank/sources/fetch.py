"""Files behind http and https: fetched once to a cache named by content, refused where they could do harm.

A cluster needs the file where all executors read it: give a cache folder that
is shared. Only addresses of the public internet are asked, on every redirect
anew; credentials in an address are never sent on or stored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import os
import shutil
import socket
import tempfile
import urllib.error
import urllib.request
from pathlib import Path
from urllib.parse import urljoin, urlsplit, urlunsplit

from oddrank.sources.readers import SourceError, canonical_uri, redacted_uri

MOST_BYTES = 2 << 30
MOST_REDIRECTS = 5
TIMEOUT = 60
PART = 1 << 20


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects are followed by hand, after the new address was looked at."""

    def redirect_request(self, *_):
        return None


def local(path: str, cache: str | None = None) -> str:
    """The path that Spark reads: of a fetched copy for http(s), without the scheme for file URLs, else as it is."""
    scheme = urlsplit(path).scheme.lower()
    if scheme in ("http", "https"):
        return fetch(path, cache or os.path.join(tempfile.gettempdir(), "oddrank-sources"))
    if scheme == "file":
        return urlsplit(path).path
    return path


def public(host: str, resolve=socket.getaddrinfo) -> None:
    """Refuse a host that is, or resolves to, an address of this machine or of an inner network."""
    try:
        found = {info[4][0] for info in resolve(host, None)}
    except OSError as e:
        raise SourceError(f"{host} can't be resolved") from e
    for address in found:
        if not ipaddress.ip_address(address.split("%")[0]).is_global:
            raise SourceError(f"{host} is not on the public internet")


def bare(uri: str) -> str:
    """The address without user and password."""
    p = urlsplit(uri)
    host = p.netloc.rpartition("@")[2]
    return urlunsplit((p.scheme, host, p.path, p.query, ""))


def fetch(uri: str, cache: str, most: int = MOST_BYTES, opener=None, check=public) -> str:
    """The path of the file behind ``uri``: asked for only if it changed since it was last fetched."""
    folder = Path(cache)
    folder.mkdir(parents=True, exist_ok=True)
    note = folder / (hashlib.sha256(canonical_uri(uri).encode()).hexdigest()[:32] + ".json")
    known = json.loads(note.read_text()) if note.exists() else {}
    if known and not Path(known["path"]).exists():
        known = {}
    headers = {"User-Agent": "oddrank"}
    if known.get("etag"):
        headers["If-None-Match"] = known["etag"]
    if known.get("modified"):
        headers["If-Modified-Since"] = known["modified"]
    opener = opener or urllib.request.build_opener(_Stay).open
    at = bare(uri)
    for _ in range(MOST_REDIRECTS + 1):
        parts = urlsplit(at)
        if parts.scheme not in ("http", "https"):
            raise SourceError(f"{redacted_uri(at)} is not http or https")
        check(parts.hostname or "")
        try:
            with opener(urllib.request.Request(at, headers=headers), timeout=TIMEOUT) as answer:
                return _kept(answer, uri, folder, note, most)
        except urllib.error.HTTPError as e:
            if e.code == 304 and known:
                return known["path"]
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                at = bare(urljoin(at, e.headers["Location"]))
                continue
            raise SourceError(f"{redacted_uri(uri)} answers {e.code}") from e
        except urllib.error.URLError as e:
            raise SourceError(f"{redacted_uri(uri)} can't be fetched: {e.reason}") from e
    raise SourceError(f"{redacted_uri(uri)} redirects more than {MOST_REDIRECTS} times")


def _kept(answer, uri: str, folder: Path, note: Path, most: int) -> str:
    digest, size = hashlib.sha256(), 0
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            while part := answer.read(PART):
                size += len(part)
                if size > most:
                    raise SourceError(f"{redacted_uri(uri)} has more than {most} bytes")
                digest.update(part)
                out.write(part)
        suffix = "".join(Path(urlsplit(uri).path).suffixes[-2:])
        path = folder / (digest.hexdigest()[:32] + suffix)
        shutil.move(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    headers = answer.headers
    note.write_text(json.dumps({"path": str(path), "etag": headers.get("ETag"), "modified": headers.get("Last-Modified"), "uri": redacted_uri(uri)}))
    return str(path)
