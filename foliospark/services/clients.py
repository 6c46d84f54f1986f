"""Chat and recognition over HTTP, with retries, and stand-ins for tests and offline use.

A client is made on the executor that uses it: pass a factory, or an instance without open connections, which these are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from foliospark.operators.ocr import normal_box


class TextModel(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class VisionModel(Protocol):
    def describe(self, image: bytes, prompt: str) -> str: ...


def strip_fences(text: str) -> str:
    """An answer without the code fence around it."""
    m = re.fullmatch(r"\s*```[\w-]*\n(.*?)\n?```\s*", text, re.S)
    return m[1] if m else text


@dataclass
class HttpModel:
    """A chat service with the usual two endpoints: ``responses``, and ``chat/completions`` where that isn't there.

    Structured output is asked for by schema, then as any JSON, then not at all, going on where the service refuses.
    """

    endpoint: str
    model: str
    key: str = ""
    timeout: float = 180.0
    retries: int = 3
    extra: dict = field(default_factory=dict)
    post: Callable[[str, dict, dict, float], dict] | None = None
    sleep: Callable[[float], None] = time.sleep
    _style: str = "responses"

    def _post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        send = self.post or _http_post
        for k in range(self.retries + 1):
            try:
                return send(f"{self.endpoint.rstrip('/')}/{path}", body | self.extra, headers, self.timeout)
            except urllib.error.HTTPError as e:
                if e.code in (400, 404, 422) or k == self.retries:
                    raise
            except OSError:
                if k == self.retries:
                    raise
            self.sleep(min(2**k, 30))
        raise AssertionError

    def _ask(self, content: list[dict], system: str, schema: dict | None) -> str:
        for form in ([{"type": "json_schema", "name": "answer", "schema": schema}, {"type": "json_object"}] if schema else []) + [None]:
            try:
                if self._style == "responses":
                    try:
                        parts = [{"type": "input_text", "text": c["text"]} if "text" in c else {"type": "input_image", "image_url": c["image"]} for c in content]
                        body = {"model": self.model, "input": [{"role": "system", "content": system}, {"role": "user", "content": parts}]}
                        out = self._post("responses", body | ({"text": {"format": form}} if form else {}))
                        return strip_fences("".join(p.get("text", "") for o in out.get("output", []) for p in o.get("content", [])) or out.get("output_text", ""))
                    except urllib.error.HTTPError as e:
                        if e.code != 404:
                            raise
                        self._style = "chat"
                parts = [{"type": "text", "text": c["text"]} if "text" in c else {"type": "image_url", "image_url": {"url": c["image"]}} for c in content]
                body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": parts}]}
                out = self._post("chat/completions", body | ({"response_format": form} if form else {}))
                return strip_fences(out["choices"][0]["message"]["content"])
            except urllib.error.HTTPError as e:
                if form is None or e.code not in (400, 422):
                    raise
        raise AssertionError

    def complete(self, system: str, user: str, schema: dict | None = None) -> str:
        return self._ask([{"text": user}], system, schema)

    def describe(self, image: bytes, prompt: str, schema: dict | None = None, mime: str = "image/png") -> str:
        return self._ask([{"text": prompt}, {"image": f"data:{mime};base64,{base64.b64encode(image).decode()}"}], "", schema)


def _http_post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
        return json.load(r)


@dataclass
class HttpRecogniser:
    """A recognition service that takes images and gives blocks; see :func:`foliospark.operators.ocr.recognise`."""

    endpoint: str
    token: str = ""
    timeout: float = 180.0
    retries: int = 5
    post: Callable[[str, dict, dict, float], dict] | None = None
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, pages: list[bytes]) -> list[list[dict]]:
        body = {"files": [base64.b64encode(p).decode() for p in pages]}
        headers = {"Content-Type": "application/json", **({"Authorization": f"token {self.token}"} if self.token else {})}
        for k in range(self.retries + 1):
            try:
                out = (self.post or _http_post)(self.endpoint, body, headers, self.timeout)
                return [[{"label": b.get("label") or b.get("block_label"), "text": b.get("text") or b.get("block_content"), "bbox": normal_box(b.get("bbox") or b.get("block_bbox")), "confidence": b.get("confidence", 1.0)} for b in p.get("blocks", [])] for p in out.get("pages", [])]
            except OSError:
                if k == self.retries:
                    raise
                self.sleep(min(2**k, 30))
        raise AssertionError


@dataclass
class Canned:
    """Answers from a table by the hash of the question, else one default: for tests, and for runs that must not pay twice."""

    answers: dict[str, str] = field(default_factory=dict)
    default: str = ""

    @staticmethod
    def key(*parts: str | bytes) -> str:
        h = hashlib.sha256()
        for p in parts:
            h.update(p if isinstance(p, bytes) else p.encode())
            h.update(b"\0")
        return h.hexdigest()

    def complete(self, system: str, user: str, schema: dict | None = None) -> str:
        return self.answers.get(self.key(system, user), self.default)

    def describe(self, image: bytes, prompt: str, schema: dict | None = None) -> str:
        return self.answers.get(self.key(image, prompt), self.default)
