"""Fetching snapshot archives over HTTPS: allow-list, retries, size limits, atomic files, a manifest.

The transport is a parameter, anything with `head` and `get` like a requests session; `Web` is one on the standard
library. `Retrying` tries again what may pass, waiting longer each time or as long as the server asks.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import http.client
import json
import os
import re
import time
import unicodedata
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from gondola.plans.warehouse import now, read_manifest, write_manifest

CHUNK = 8 << 20
# Fixed values of the public source: weekdays in addresses, and which answers may pass on another try.
SLOTS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")
RETRY_STATUS = (408, 429, 500, 502, 503, 504)
RETRIES, BACKOFF = 5, 1.0
CATALOG = "https://datos.gob.ar/api/3/action/package_show?id=precios-claros-base-sepa"
ARCHIVE_HOST = "datos.produccion.gob.ar"
ARCHIVE_PATH = r"/dataset/6f47ec76-d1ce-4e34-a7e1-621fe9b1d0b5/resource/[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}/download/sepa_([a-z]+)\.zip"


class DownloadError(RuntimeError):
    pass


@dataclass(frozen=True)
class Policy:
    hosts: frozenset[str]
    most_bytes: int = 8 << 30
    #: An archive's path, whose group is the weekday; None allows any.
    path: str | None = None
    #: The one address of the catalog; None allows any on the hosts.
    catalog: str | None = None


def public_policy() -> Policy:
    """Of the public source; MAX_HTTP_DOWNLOAD_BYTES changes the size limit."""
    return Policy(frozenset({urlsplit(CATALOG).hostname, ARCHIVE_HOST}), int(os.environ.get("MAX_HTTP_DOWNLOAD_BYTES", 8 << 30)), ARCHIVE_PATH, CATALOG)


def check_url(url: str, policy: Policy) -> str:
    """The address, if it is nothing but https, an allowed host, a path and perhaps a query."""
    parts = urlsplit(url)
    plain = f"https://{parts.hostname}{parts.path}" + (f"?{parts.query}" if parts.query else "")
    if parts.hostname not in policy.hosts or url != plain:
        raise DownloadError(f"address not allowed: {url}")
    return url


def archive_url(url: str, day: str, policy: Policy) -> str:
    """The address, if it is that of this weekday's archive."""
    parts = urlsplit(check_url(url, policy))
    if policy.path is not None:
        found = re.fullmatch(policy.path, parts.path)
        if parts.query or day not in SLOTS or not found or found[1] != day:
            raise DownloadError(f"no archive of {day}: {url}")
    return url


class Retrying:
    """A transport that tries again after connection errors and answers that may pass."""

    def __init__(self, transport, retries: int = RETRIES, backoff: float = BACKOFF, wait: Callable[[float], None] = time.sleep):
        self.transport, self.retries, self.backoff, self.wait = transport, retries, backoff, wait

    def _tried(self, call: Callable, url: str, more: dict):
        for turn in range(self.retries + 1):
            last, pause = turn == self.retries, self.backoff * 2**turn
            try:
                reply = call(url, **more)
            except (OSError, http.client.HTTPException):
                if last:
                    raise
            else:
                if last or reply.status_code not in RETRY_STATUS:
                    return reply
                asked = str(reply.headers.get("Retry-After", ""))
                pause = float(asked) if asked.isdigit() else pause
            self.wait(pause)

    def head(self, url: str, **more):
        return self._tried(self.transport.head, url, more)

    def get(self, url: str, **more):
        return self._tried(self.transport.get, url, more)


class _Reply:
    def __init__(self, body, status: int, headers):
        self.body, self.status_code, self.headers = body, status, headers

    def json(self):
        return json.load(self.body)

    def iter_content(self, size: int) -> Iterator[bytes]:
        while block := self.body.read(size):
            yield block

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.body.close()


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


class Web:
    """HTTPS by the standard library; redirects come back as they are."""

    def __init__(self):
        self.opener = urllib.request.build_opener(_NoRedirect)

    def _ask(self, method: str, url: str, timeout: float = 60, **_):
        try:
            reply = self.opener.open(urllib.request.Request(url, method=method), timeout=timeout)
        except urllib.error.HTTPError as error:
            reply = error
        return _Reply(reply, reply.status, reply.headers)

    def head(self, url: str, **more):
        return self._ask("HEAD", url, **more)

    def get(self, url: str, **more):
        return self._ask("GET", url, **more)


def checked(response, policy: Policy):
    if response.status_code in (301, 302, 303, 307, 308):
        raise DownloadError("redirects are not followed")
    if response.status_code != 200:
        raise DownloadError(f"status {response.status_code}")
    size = response.headers.get("Content-Length")
    if size is not None and not 0 < int(size) <= policy.most_bytes:
        raise DownloadError(f"size {size}")
    return response


def slug(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return "_".join(re.findall("[a-z0-9]+", plain))


def catalog(session, url: str, policy: Policy) -> dict[str, str]:
    """Weekday -> address: exactly seven archives, one for each weekday."""
    if policy.catalog is not None and url != policy.catalog:
        raise DownloadError(f"no catalog: {url}")
    found: dict[str, str] = {}
    for item in checked(session.get(check_url(url, policy), allow_redirects=False, timeout=60), policy).json()["result"]["resources"]:
        day = next((d for d in SLOTS if d in slug(item.get("name", ""))), None)
        if item.get("format", "").upper() == "ZIP" and day:
            if day in found:
                raise DownloadError(f"two archives for {day}")
            found[day] = archive_url(item["url"], day, policy)
    if len(found) != len(SLOTS):
        raise DownloadError(f"archives for {sorted(found)} only")
    return found


def same_as_before(headers: dict, row: dict) -> bool:
    """By entity tag, or else by date and length."""
    if headers.get("ETag") and row.get("etag"):
        return headers["ETag"] == row["etag"]
    return bool(headers.get("Last-Modified")) and (headers.get("Last-Modified"), str(headers.get("Content-Length"))) == (row.get("last_modified"), str(row.get("bytes")))


def fetch(session, url: str, day: str, raw: Path, manifest: Path, policy: Policy, date: dt.date) -> Path:
    """The archive's path. Files are never overwritten; equal contents are kept once."""
    rows = read_manifest(manifest)
    head = checked(session.head(archive_url(url, day, policy), allow_redirects=False, timeout=60), policy).headers
    for row in reversed(rows):
        if row["url"] == url and same_as_before(head, row) and Path(row["path"]).exists():
            return Path(row["path"])
    folder = raw / date.isoformat()
    folder.mkdir(parents=True, exist_ok=True)
    part, digest, size = folder / f"sepa_{day}.zip.part", hashlib.sha256(), 0
    try:
        with checked(session.get(url, stream=True, allow_redirects=False, timeout=60), policy) as response, part.open("wb") as out:
            for chunk in response.iter_content(CHUNK):
                size += len(chunk)
                if size > policy.most_bytes:
                    raise DownloadError("the archive is larger than allowed")
                digest.update(chunk)
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        for row in rows:
            if row["sha256"] == digest.hexdigest() and Path(row["path"]).exists():
                return Path(row["path"])
        path = folder / f"sepa_{day}.zip"
        if path.exists():
            raise DownloadError(f"{path} exists with other contents")
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)
    write_manifest(manifest, [*rows, {"url": url, "path": str(path), "sha256": digest.hexdigest(), "bytes": size, "etag": head.get("ETag"), "last_modified": head.get("Last-Modified"), "fetched_at": now()}])
    return path


def download(raw: Path, manifest: Path, date: dt.date, transport=None, policy: Policy | None = None, url: str = CATALOG) -> dict[str, Path]:
    """The seven archives of the catalog, by weekday."""
    session, policy = Retrying(transport or Web()), policy or public_policy()
    return {day: fetch(session, address, day, raw, manifest, policy, date) for day, address in catalog(session, url, policy).items()}
