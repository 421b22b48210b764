"""A chat model behind HTTP, as a client for entities.asked()."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.request import Request, urlopen


@dataclass(frozen=True)
class ChatService:
    """Where a model is served, and how it is asked. Calling it gives the function that asked() needs in each task.

    The service lists its models at /api/tags and answers at /api/chat, in one piece.
    """

    url: str
    model: str
    labels: tuple[str, ...]
    timeout: float = 60.0
    temperature: float = 0.1
    tokens: int = 2048
    key: str | None = None

    def _request(self, path: str, body: dict | None = None) -> Request:
        """A key is sent as a bearer token."""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return Request(f"{self.url.rstrip('/')}{path}", json.dumps(body).encode() if body else None, headers)  # noqa: S310

    def models(self) -> list[str]:
        with urlopen(self._request("/api/tags"), timeout=self.timeout) as answer:  # noqa: S310
            return [m["name"] for m in json.load(answer)["models"]]

    def healthy(self) -> bool:
        """Whether the service can be reached and has a model of just this name."""
        try:
            return self.model in self.models()
        except (OSError, ValueError, KeyError, TypeError):
            return False

    def __call__(self) -> Callable[[str], str]:
        def ask(text: str) -> str:
            messages = [{"role": "system", "content": instruction(self.labels)}, {"role": "user", "content": text}]
            body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.tokens}}
            with urlopen(self._request("/api/chat", body), timeout=self.timeout) as answer:  # noqa: S310
                return json.load(answer)["message"]["content"]

        return ask


def instruction(labels: Sequence[str]) -> str:
    return (
        "List what the user's text names, word for word, under these labels: " + ", ".join(labels) + ". "
        'Answer with one JSON object, {"entities": [{"text": "...", "label": "..."}]}, and nothing else.'
    )
