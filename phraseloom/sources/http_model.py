"""A text model behind an HTTP interface, as the classifier that reclassification asks."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class HttpClassifier:
    """Posts a prompt, returns the response body.

    ``url`` may hold {model} and {key}.  The request is
    ``{"contents": [{"parts": [{"text": prompt}]}], "generationConfig": ...}``
    with JSON answers at temperature 0; ``operators.reclassify.labels_of``
    reads the labels from such a response.  Errors carry the status code, so
    that 429, 500 and 503 are tried again.  The object holds settings only and
    is sent to the workers as it is.
    """

    url: str
    key: str = ""
    model: str = ""
    per_minute: int = 0
    timeout_seconds: float = 120.0

    @classmethod
    def from_env(cls, prefix: str, env=os.environ, url: str | None = None, model: str = "") -> HttpClassifier:
        """Settings from <prefix>URL, <prefix>API_KEY (required), <prefix>MODEL and <prefix>RPM (calls a minute, 0 for no limit)."""
        if not env.get(f"{prefix}API_KEY"):
            raise ValueError(f"{prefix}API_KEY is not set")
        try:
            per_minute = max(0, int(env.get(f"{prefix}RPM", "0").strip()))
        except ValueError:
            per_minute = 0
        place = env.get(f"{prefix}URL", url)
        if not place:
            raise ValueError(f"{prefix}URL is not set")
        return cls(place, env[f"{prefix}API_KEY"], env.get(f"{prefix}MODEL", model), per_minute)

    def body(self, prompt: str) -> bytes:
        settings = {"responseMimeType": "application/json", "temperature": 0}
        return json.dumps({"contents": [{"parts": [{"text": prompt}]}], "generationConfig": settings}).encode()

    def __call__(self, prompt: str) -> str:
        place = self.url.replace("{model}", self.model).replace("{key}", self.key)
        request = urllib.request.Request(place, self.body(prompt), {"content-type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_seconds) as response:
                return response.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"http {e.code}") from None
