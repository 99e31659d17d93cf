"""The driver's side of a run: a store of contracts kept by the hash of what made them, approvals, and the retry rule for a provider of replies."""

from __future__ import annotations

import datetime as dt
import email.utils
import hashlib
import json
import os
import tempfile
from dataclasses import dataclass

_FILES = ("body.json", "manifest.json", "review.json")


def canonical(value: object) -> bytes:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def write_atomically(path: str, data: bytes) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


class ContractStore:
    """Contracts in folders by key. The list of hashes is written last, so that a contract is there as a whole or not at all."""

    def __init__(self, root: str):
        self.root = root

    @staticmethod
    def key(sources: list[dict], **made_by: str) -> str:
        """The key for sources (their paths don't count) and what the contract is made by: versions, prompt, model, effort."""
        return digest({"sources": sorted(({k: v for k, v in s.items() if "path" not in k} for s in sources), key=canonical), **made_by})

    def save(self, key: str, body: dict, manifest: dict, review: dict) -> None:
        folder = os.path.join(self.root, key)
        os.makedirs(folder, exist_ok=True)
        hashes = {}
        for name, value in zip(_FILES, (body, manifest | {"cache_key": key}, review), strict=True):
            data = canonical(value)
            hashes[name] = hashlib.sha256(data).hexdigest()
            write_atomically(os.path.join(folder, name), data)
        write_atomically(os.path.join(folder, "ready.json"), canonical(hashes))

    def _read(self, key: str) -> dict[str, dict] | None:
        folder = os.path.join(self.root, key)
        try:
            with open(os.path.join(folder, "ready.json"), "rb") as f:
                hashes = json.load(f)
            out = {}
            for name in _FILES:
                with open(os.path.join(folder, name), "rb") as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != hashes[name]:
                    return None
                out[name] = json.loads(data)
        except (OSError, ValueError, KeyError):
            return None
        return out if out["manifest.json"].get("cache_key") == key else None

    def load(self, key: str) -> tuple[dict, dict, dict] | None:
        """Body, manifest and review; None if anything is missing or changed, or the review has blocked it."""
        found = self._read(key)
        return None if found is None or found["review.json"].get("status") == "blocked" else tuple(found[n] for n in _FILES)

    def status(self, key: str) -> str | None:
        found = self._read(key)
        return None if found is None else found["review.json"].get("status")

    def best(self, model: str, effort: str) -> str | None:
        """The usable contract of this model and effort that was made last, or of others if there is none."""
        found = [(k, m[1]) for k in sorted(os.listdir(self.root)) if (m := self.load(k))] if os.path.isdir(self.root) else []
        return max(found, key=lambda x: ((x[1].get("model"), x[1].get("effort")) == (model, effort), x[1].get("generated_at", "")), default=(None,))[0]

    def approve_aliases(self, key: str, body_hash: str, aliases: list[dict], note: str, now: dt.datetime) -> str:
        """A new contract with aliases (field_id, value_code, alias) added to options of enum fields. It is bound to the body that was looked at; an alias that another option has, and one that changes nothing, are refused."""
        found = self.load(key)
        if found is None or digest(found[0]) != body_hash:
            raise ValueError("the contract has changed or can't be used")
        body = json.loads(canonical(found[0]))
        for a in aliases:
            field = next((f for f in body["fields"] if f["field_id"] == a["field_id"] and f["value_kind"] == "enum"), None)
            option = next((o for o in (field or {}).get("allowed_values", ()) if o["code"] == a["value_code"]), None)
            if option is None:
                raise ValueError("aliases belong to options of enum fields")
            names = {o["code"]: {o["code"], o["display_name"], *o.get("aliases", ())} for o in field["allowed_values"]}
            if a["alias"] in names.pop(option["code"]) or any(a["alias"] in n for n in names.values()):
                raise ValueError("the alias is there already or belongs to another option")
            option.setdefault("aliases", []).append(a["alias"])
        new = digest({"base": key, "body": digest(body), "note": note})
        self.save(new, body, found[1] | {"generated_at": now.isoformat()}, {"status": "manual_approved", "note": note, "base": key})
        return new


@dataclass(frozen=True)
class Retry:
    """What to do after a failed request: wait so many seconds, or stop for a reason."""

    wait: float | None
    reason: str = ""


def retry_plan(status: int | None, attempt: int, elapsed: float, retry_after: str | None = None, now: dt.datetime | None = None, attempts: int = 3, deadline: float = 600) -> Retry:
    """status: None for a lost connection; attempt from 0. Rejections stop at once; only lost connections, 408, 429 and server errors are tried again, within attempts and deadline."""
    if status in (400, 401, 403):
        return Retry(None, "rejected")
    if not (status is None or status in (408, 429) or 500 <= status <= 599):
        return Retry(None, "failed")
    if attempt + 1 >= attempts:
        return Retry(None, "exhausted")
    wait = _seconds(retry_after, now or dt.datetime.now(dt.UTC))
    wait = float(2**attempt) if wait is None else wait
    return Retry(None, "exhausted") if elapsed + wait > deadline else Retry(wait)


def _seconds(header: str | None, now: dt.datetime) -> float | None:
    """Seconds of a Retry-After header, a number or a date; never less than 0."""
    if header is None:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        when = email.utils.parsedate_to_datetime(header)
    except ValueError:
        return None
    when = when if when.tzinfo else when.replace(tzinfo=dt.UTC)
    return max(0.0, (when - now).total_seconds())


@dataclass(frozen=True)
class Settings:
    """A run's settings from the environment; the key is never shown, the address must be HTTPS."""

    base_url: str
    model: str
    as_of: dt.date
    api_key: str = ""

    @classmethod
    def from_environment(cls, env: dict[str, str], now: dt.datetime | None = None) -> Settings:
        url = env.get("RULEWRIGHT_BASE_URL", "https://localhost")
        if not url.startswith("https://"):
            raise ValueError("the address must be HTTPS")
        china = (now or dt.datetime.now(dt.UTC)).astimezone(dt.timezone(dt.timedelta(hours=8))).date()
        day = dt.date.fromisoformat(env["RULEWRIGHT_AS_OF"]) if env.get("RULEWRIGHT_AS_OF") else china
        return cls(url, env.get("RULEWRIGHT_MODEL", "replay"), day, env.get("RULEWRIGHT_API_KEY", ""))

    def __repr__(self) -> str:
        return f"Settings(base_url={self.base_url!r}, model={self.model!r}, as_of={self.as_of}, api_key={'***' if self.api_key else ''!r})"
