"""Embeddings: providers, and the default one, signed feature hashing."""

from __future__ import annotations

import hashlib
import json
import string
import urllib.request
from typing import Iterator, Protocol, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

MIN_BYTES = 5
#: Texts, and their characters, that are embedded at once.
MOST_TEXTS, MOST_CHARS = 256, 1 << 20


class EmbeddingError(Exception):
    pass


class Provider(Protocol):
    """What an embedding model offers; ``embed_batch`` gets the texts of a batch
    at once and must be picklable."""

    dimension: int
    model_id: str

    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


def tokenize(text: str) -> list[str]:
    """Words between Unicode white space, in lower case, without ASCII
    punctuation at their ends."""
    return [t for t in (w.strip(string.punctuation).lower() for w in text.split()) if t]


class HashProvider:
    """Each token adds +1 or -1 to one of ``dimension`` buckets, both drawn from
    its MD5; the sum is scaled to length 1. A text without tokens is the zero
    vector."""

    model_id = "hash-md5-v1"

    def __init__(self, dimension: int = 256):
        if dimension < 1:
            raise ValueError("the dimension must be positive")
        self.dimension = dimension
        self._known: dict[str, tuple[int, int]] = {}

    def place(self, token: str) -> tuple[int, int]:
        found = self._known.get(token)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            digest = hashlib.md5(token.encode()).hexdigest()
            found = self._known[token] = (int(digest[:8], 16) % self.dimension, 1 if int(digest[8], 16) % 2 == 0 else -1)
        return found

    def array(self, texts: Sequence[str]) -> np.ndarray:
        """The vectors as rows of 32-bit floats."""
        places = [(i * self.dimension + at, sign) for i, text in enumerate(texts) for at, sign in map(self.place, tokenize(text))]
        at, sign = np.array(places, np.int64).reshape(-1, 2).T
        v = np.bincount(at, sign, len(texts) * self.dimension).reshape(len(texts), self.dimension)
        norm = np.sqrt((v * v).sum(1, keepdims=True))  # of whole numbers, so exact in any order
        return (v / np.where(norm > np.finfo(np.float32).eps, norm, 1)).astype(np.float32)

    def embed(self, text: str) -> list[float]:
        return self.array([text])[0].tolist()

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return self.array(texts).tolist()


class HttpProvider:
    """An embedding server. ``kind``: ``ollama`` (``/api/embed``) or ``openai``
    (``/v1/embeddings``)."""

    DEFAULTS = {"ollama": ("http://localhost:11434", "nomic-embed-text", 768, "/api/embed"), "openai": ("https://api.openai.com", "text-embedding-3-small", 1536, "/v1/embeddings")}

    def __init__(self, kind: str, base: str | None = None, model: str | None = None, dimension: int | None = None, key: str | None = None, timeout: float = 30):
        url, name, size, self.route = self.DEFAULTS[kind]
        self.kind, self.base, self.model_id, self.dimension = kind, (base or url).rstrip("/"), model or name, dimension or size
        self.key, self.timeout = key, timeout

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not len(texts):
            return []
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.base + self.route, json.dumps({"model": self.model_id, "input": list(texts)}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                body = json.load(answer)
            found = body["embeddings"] if self.kind == "ollama" else [x["embedding"] for x in sorted(body["data"], key=lambda x: x["index"])]
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise EmbeddingError(f"{self.base}: {e}") from e
        if len(found) != len(texts):
            raise EmbeddingError(f"{len(texts)} texts, but {len(found)} embeddings")
        return found


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts that aren't null, some at a time."""
    some, chars = [], 0
    for x in texts:
        text = x.as_py()
        if text is None:
            continue
        if some and (len(some) == MOST_TEXTS or chars + len(text) > MOST_CHARS):
            yield some
            some, chars = [], 0
        some.append(text)
        chars += len(text)
    if some:
        yield some


def vectors(texts: pa.Array, provider: Provider) -> pa.Array:
    """An embedding for every text, null for null. Vectors are made for some
    texts at a time and kept as 32-bit floats, so a batch needs little more than
    its result."""
    values, sizes = [], []
    for some in groups(texts):
        if isinstance(provider, HashProvider):
            made = provider.array(some)
            values.append(pa.array(made.ravel()))
            sizes += [provider.dimension] * len(made)
        else:
            made = pa.array(provider.embed_batch(some), pa.list_(pa.float32()))
            values.append(made.flatten())
            sizes += made.value_lengths().to_pylist()
    null = texts.is_null().to_numpy(zero_copy_only=False)
    ends = np.zeros(len(texts) + 1, np.int32)
    ends[1:][~null] = sizes
    flat = pa.concat_arrays(values) if values else pa.array([], pa.float32())
    return pa.ListArray.from_arrays(pa.array(ends.cumsum(dtype=np.int32)), flat, mask=pa.array(null))


def embed(text: Column, provider: Provider | None = None) -> Column:
    """The embedding of a text column, some texts at a time; null stays null."""
    provider = provider or HashProvider()

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return vectors(texts, provider)

    return run(text)


_SPACE = "\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def long_enough(text: Column) -> Column:
    """Whether a text has at least five bytes besides white space at its ends."""
    return F.octet_length(trimmed(text)) >= MIN_BYTES
