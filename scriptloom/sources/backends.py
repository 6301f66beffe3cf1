"""Model backends: the contract, HTTP clients for two kinds of server, and partition functions that call them.

A request that was sent is never sent again after a transport error: the server may be at work on it. Results go to
the cache from inside the task, so that a retried task finds them.
"""

from __future__ import annotations

import base64
import json
import os
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any, Protocol
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import Request, urlopen

from ..errors import BackendError, ConfigurationError, ModelOutputError
from ..functions.replies import ITEM, LINE, MAX_OBJECTS, MAX_PEOPLE, MAX_SHOTS, MAX_VISIBLE, SUMMARY, audio_record, json_object, visual_record
from ..streaming.responses import content, read_ndjson, read_sse
from . import prompts

#: Replies worth another try, sampling, and the least room for a second visual try.
TRANSIENT, TRIES, RETRY_TOKENS = {408, 409, 429, 500, 502, 503, 504}, 3, 6144
SAMPLING = {"temperature": 1.0, "top_p": 0.95, "top_k": 64}


class Analyzer(Protocol):
    """What a backend does. Both give canonical records with absolute times."""

    def load(self) -> None: ...

    def transcribe(self, audio: str, *, start: float, seconds: float, language: str | None, translate_to: str | None) -> dict: ...

    def describe(self, video: str, *, start: float, seconds: float, frames: list[str], transcript: str | None, continuity: str | None, user_context: str | None) -> dict: ...


def _object(**fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def _string(most: int | None = None) -> dict:
    return {"type": "string"} | ({"maxLength": most} if most else {})


def _many(of: dict, most: int | None = None) -> dict:
    return {"type": "array", "items": of} | ({"maxItems": most} if most else {})


MAYBE, NUMBER = {"type": ["string", "null"]}, {"type": "number"}
AUDIO_SCHEMA = _object(language=_string(), transcript=_string(), translation=MAYBE, segments=_many(_object(start=NUMBER, end=NUMBER, speaker=_string(), text=_string(), translation=MAYBE)), non_speech_audio=_many(_string()))
VISUAL_SCHEMA = _object(
    summary=_string(SUMMARY), shots=_many(_object(start=NUMBER, end=NUMBER, description=_string(LINE), visible_text=_many(_string(ITEM), MAX_VISIBLE)), MAX_SHOTS),
    people=_many(_string(ITEM), MAX_PEOPLE), objects=_many(_string(ITEM), MAX_OBJECTS), setting=_string(LINE),
)


class JsonClient:
    """JSON over HTTP. opener and sleep can be replaced in tests."""

    def __init__(self, url: str, key: str | None = None, timeout: float = 3600, opener: Callable[..., Any] = urlopen, sleep: Callable[[float], None] = time.sleep):
        self.url, self.timeout, self.opener, self.sleep = url.rstrip("/"), timeout, opener, sleep
        self.headers = {"Accept": "application/json", "Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def _send(self, request: Request, read: Callable[[Any], Any], again: bool) -> Any:
        for left in reversed(range(TRIES)):
            try:
                with self.opener(request, timeout=self.timeout) as response:
                    return read(response)
            except HTTPError as e:
                if not left or e.code not in TRANSIENT:
                    raise BackendError(f"HTTP {e.code} from {request.full_url}: {e.read().decode(errors='replace')[:500]}") from e
            except (URLError, OSError) as e:
                if not left or not again:
                    raise BackendError(f"no answer from {request.full_url}: {e}") from e
            self.sleep(0.5 * 2 ** (TRIES - 1 - left))

    def get(self, path: str) -> None:
        self._send(Request(self.url + path, headers=self.headers, method="GET"), lambda r: r.read(), True)

    def post(self, path: str, payload: dict, read: Callable[[Any], str]) -> str:
        return self._send(Request(self.url + path, data=json.dumps(payload).encode(), headers=self.headers, method="POST"), read, False)


def _file(path: str) -> str:
    try:
        return base64.b64encode(Path(path).read_bytes()).decode()
    except OSError as e:
        raise BackendError(f"can't read {path}: {e}") from e


class _Server:
    """What the servers share: key, one health check, and a retry of pictures whose reply wasn't finished."""

    name, suffix, health = "", "", ""

    def __init__(self, model: str, url: str, *, key_variable: str | None = None, timeout: float = 3600, stream: bool = True, context: int = 16384, max_tokens: int = 4096, seed: int = 7, opener: Callable[..., Any] = urlopen):
        key = os.environ.get(key_variable) if key_variable else None
        if key_variable and not key:
            raise ConfigurationError(f"{key_variable} isn't set")
        self.client = JsonClient(url.rstrip("/").removesuffix(self.suffix), key, timeout, opener)
        self.model, self.stream, self.context, self.max_tokens, self.seed, self._ready = model, stream, context, max_tokens, seed, False

    def load(self) -> None:
        if not self._ready:
            self.client.get(self.health)
            self._ready = True

    def _ask(self, messages: list[dict], schema: dict, max_tokens: int | None = None) -> dict:
        self.load()
        text = self._call(messages, schema, max_tokens or self.max_tokens)
        if not text.strip():
            raise ModelOutputError(f"{self.name} gave an empty answer")
        return json_object(text)

    def _call(self, messages: list[dict], schema: dict, max_tokens: int) -> str:
        raise NotImplementedError

    def _path(self, response: Any, *path: str | int) -> str:
        try:
            value = json.loads(response.read())
            for p in path:
                value = value[p]
            return content(value)
        except (KeyError, IndexError, TypeError, json.JSONDecodeError) as e:
            raise BackendError(f"{self.name} gave an unknown answer") from e


class ChatServer(_Server):
    """A llama.cpp server, by its OpenAI-like chat interface."""

    name, suffix, health = "llama-cpp", "/v1", "/health"

    def __init__(self, model: str, url: str = "http://127.0.0.1:8080", *, media_mode: str = "base64", media_root: str | None = None, **more: Any):
        super().__init__(model, url, **more)
        self.media_mode, self.media_root = media_mode, media_root

    def _media(self, path: str) -> dict:
        if self.media_mode == "base64":
            return {"data": _file(path)}
        if self.media_mode != "file-url" or self.media_root is None:
            raise ConfigurationError("media go as base64, or as file-url with a media root")
        try:
            below = Path(path).resolve().relative_to(Path(self.media_root).resolve())
        except ValueError as e:
            raise ConfigurationError(f"{path} is outside the media root") from e
        return {"url": f"file://{quote(below.as_posix())}"}

    def _call(self, messages: list[dict], schema: dict, max_tokens: int) -> str:
        payload = {"model": self.model, "messages": messages, "max_tokens": max_tokens, **SAMPLING, "seed": self.seed, "stream": self.stream,
                   "response_format": {"type": "json_schema", "schema": schema}, "chat_template_kwargs": {"enable_thinking": False}, "reasoning_effort": "none"}
        return self.client.post("/v1/chat/completions", payload, read_sse if self.stream else lambda r: self._path(r, "choices", 0, "message", "content"))

    def _messages(self, parts: list[dict]) -> list[dict]:
        return [{"role": "system", "content": prompts.SYSTEM}, {"role": "user", "content": parts}]

    def transcribe(self, audio: str, *, start: float, seconds: float, language: str | None = None, translate_to: str | None = None) -> dict:
        text = {"type": "text", "text": prompts.audio_prompt(language, translate_to, seconds)}
        return audio_record(self._ask(self._messages([text, {"type": "input_audio", "input_audio": self._media(audio)}]), AUDIO_SCHEMA), start, seconds)

    def describe(self, video: str, *, start: float, seconds: float, frames: list[str] = [], transcript: str | None = None, continuity: str | None = None, user_context: str | None = None) -> dict:
        if frames:
            url = lambda p: {"url": f"data:image/jpeg;base64,{_file(p)}"} if self.media_mode == "base64" else self._media(p)
            media = [{"type": "image_url", "image_url": url(p)} for p in frames]
        else:
            media = [{"type": "input_video", "input_video": self._media(video)}]
        prompt = prompts.visual_prompt(seconds, len(frames) or None, transcript=transcript, continuity=continuity, user_context=user_context)
        room = max(self.max_tokens, min(RETRY_TOKENS, self.context // 2))
        for text, tokens in ((prompt, None), (prompt + prompts.RETRY, room)):
            try:
                return visual_record(self._ask(self._messages([*media, {"type": "text", "text": text}]), VISUAL_SCHEMA, tokens), start, seconds)
            except ModelOutputError:
                if tokens:
                    raise
        raise AssertionError


class GenerateServer(_Server):
    """An Ollama server: whole windows in `images`, no second try."""

    name, suffix, health = "ollama", "/api", "/api/tags"

    def __init__(self, model: str, url: str = "http://127.0.0.1:11434", *, keep_alive: str = "30m", **more: Any):
        super().__init__(model, url, **more)
        self.keep_alive = keep_alive

    def _call(self, messages: list[dict], schema: dict, max_tokens: int) -> str:
        options = SAMPLING | {"seed": self.seed, "num_predict": max_tokens, "num_ctx": self.context}
        payload = {"model": self.model, "messages": messages, "stream": self.stream, "format": schema, "think": False, "keep_alive": self.keep_alive, "options": options}
        return self.client.post("/api/chat", payload, read_ndjson if self.stream else lambda r: self._path(r, "message", "content"))

    def _messages(self, prompt: str, media: list[str]) -> list[dict]:
        return [{"role": "system", "content": prompts.SYSTEM}, {"role": "user", "content": prompt, "images": [_file(p) for p in media]}]

    def transcribe(self, audio: str, *, start: float, seconds: float, language: str | None = None, translate_to: str | None = None) -> dict:
        return audio_record(self._ask(self._messages(prompts.audio_prompt(language, translate_to, seconds), [audio]), AUDIO_SCHEMA), start, seconds)

    def describe(self, video: str, *, start: float, seconds: float, frames: list[str] = [], transcript: str | None = None, continuity: str | None = None, user_context: str | None = None) -> dict:
        prompt = prompts.visual_prompt(seconds, None, transcript=transcript, continuity=continuity, user_context=user_context)
        return visual_record(self._ask(self._messages(prompt, [video]), VISUAL_SCHEMA), start, seconds)


class LocalModel:
    """A model run in the worker. generate(kind, prompt, media) -> text; it is made on the first call."""

    def __init__(self, make: Callable[[], Callable[[str, str, list[str]], str]]):
        self._make, self._generate = make, None

    def load(self) -> None:
        self._generate = self._generate or self._make()

    def _ask(self, kind: str, prompt: str, media: list[str]) -> dict:
        self.load()
        return json_object(self._generate(kind, prompt, media))

    def transcribe(self, audio: str, *, start: float, seconds: float, language: str | None = None, translate_to: str | None = None) -> dict:
        return audio_record(self._ask("audio", prompts.audio_prompt(language, translate_to, seconds), [audio]), start, seconds)

    def describe(self, video: str, *, start: float, seconds: float, frames: list[str] = [], transcript: str | None = None, continuity: str | None = None, user_context: str | None = None) -> dict:
        prompt = prompts.visual_prompt(seconds, None, transcript=transcript, continuity=continuity, user_context=user_context)
        return visual_record(self._ask("visual", prompt, [video]), start, seconds)
