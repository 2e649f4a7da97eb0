"""Frames of media inputs of every kind in one plan; inputs that can't be read go to an error table and don't end the job."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How image files of each suffix begin.
IMAGES = {".jpg": (b"\xff\xd8",), ".jpeg": (b"\xff\xd8",), ".png": (b"\x89PNG\r\n\x1a\n",), ".webp": (b"RIFF",), ".bmp": (b"BM",)}
#: A decoder gets an open file and yields (height, width, RGB bytes) frame by frame.
Decoder = Callable[[object], Iterator[tuple[int, int, bytes]]]

SCHEMA = "video_path string, kind string, frame_pos long, height long, width long, content binary, error string"


@dataclass
class Frames:
    """frames (video_path, kind, frame_pos, height, width, content), height and width null for encoded images; errors (video_path, kind,
    error); sources (video_path, kind, decode_backend, decode_strategy, temporal_coverage_status, formal_sampling_eligible, frames)."""

    frames: DataFrame
    errors: DataFrame
    sources: DataFrame


def _kind(path: str) -> str:
    return "npz" if path.lower().endswith(".npz") else "video"


def arrays(held) -> np.ndarray:
    """The frames of an open NPZ archive as bytes, channels last: `frames` or the first array; values up to 1 are scaled."""
    with np.load(held, allow_pickle=False) as archive:
        if not archive.files:
            raise ValueError("the archive holds no array")
        x = archive["frames"] if "frames" in archive.files else archive[archive.files[0]]
    if x.ndim != 4:
        raise ValueError("frames must have four axes")
    if x.shape[-1] not in (1, 3, 4) and x.shape[1] in (1, 3, 4):
        x = x.transpose(0, 2, 3, 1)
    if x.dtype != np.uint8:
        x = x.astype(np.float64) * (255 if x.size and x.max() <= 1.0 else 1)
        x = np.clip(x, 0, 255).astype(np.uint8)
    return x


def _folder(store, path: str) -> Iterator[tuple]:
    from pyarrow import fs

    suffix = lambda p: (re.search(r"\.[^./]+$", p) or [""])[0].lower()
    names = sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and suffix(i.path) in IMAGES)
    if not names:
        raise ValueError("the folder holds no images")
    for k, name in enumerate(names):
        with store.open_input_stream(name) as f:
            content = f.read()
        if not content.startswith(IMAGES[suffix(name)]):
            raise ValueError(f"{name.rsplit('/', 1)[-1]} is not an image of its kind")
        yield k, None, None, content


def _rows(path: str | None, decoders: dict[str, Decoder]) -> Iterator[tuple]:
    """Rows of SCHEMA of one input. Its frames come only once all were read, so an input is either whole or an error."""
    from pyarrow import fs

    kind = "none"
    try:
        if not (path or "").strip():
            raise ValueError("the path is empty")
        if (local := re.sub(r"^file:/+", "/", path)).startswith("/") or "://" not in path:
            store, name = fs.LocalFileSystem(), local
        else:
            store, name = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
        info = store.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError("nothing is there")
        if info.type == fs.FileType.Directory:
            kind, found = "image_dir", _folder(store, name)
        elif (kind := _kind(name)) == "npz":
            with store.open_input_file(name) as f:
                x = arrays(f)
            if not len(x):
                raise ValueError("the array holds no frames")
            found = ((k, frame.shape[0], frame.shape[1], frame.tobytes()) for k, frame in enumerate(x))
        else:
            suffix = (re.search(r"\.[^./]+$", name) or [""])[0].lower()
            if suffix not in decoders:
                raise ValueError(f"no decoder for {suffix or 'files without a suffix'}")
            with store.open_input_file(name) as f:
                found = [(k, *frame) for k, frame in enumerate(decoders[suffix](f))]
            if not found:
                raise ValueError("the decoder gave no frames")
        held = list(found)
    except (ValueError, OSError, EOFError, KeyError, zipfile.BadZipFile, pa.ArrowException) as e:
        yield path, kind, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    for k, height, width, content in held:
        yield path, kind, k, height, width, content, None


def load_frames(samples: DataFrame, decoders: dict[str, Decoder] | None = None) -> Frames:
    """Frames of the distinct video_path values of samples. A folder gives its images in order of name, an archive its array; other files
    need a decoder for their suffix (in lower case, with the dot). An empty path, a missing input, an empty folder or archive, a broken image or
    archive and a suffix without a decoder each give one row of errors, and none of frames."""
    known = dict(decoders or {})

    def read(batches):
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
        for batch in batches:
            for path in batch.column("video_path").to_pylist():
                for row in _rows(path, known):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    rows = samples.select("video_path").distinct().mapInArrow(read, SCHEMA)
    good = rows.where("error is null")
    backend = F.create_map(*[F.lit(x) for x in ("image_dir", "image_directory", "npz", "numpy", "video", "decoder")])
    early = F.col("kind") != "video"
    sources = good.groupBy("video_path", "kind").agg(F.count(F.lit(1)).alias("frames")).select(
        "video_path", "kind", backend[F.col("kind")].alias("decode_backend"), F.when(early, "preextracted_frames").otherwise("decoded").alias("decode_strategy"),
        F.when(early, "ordered_preextracted_frames").otherwise("unverified").alias("temporal_coverage_status"), early.alias("formal_sampling_eligible"), "frames",
    )
    return Frames(good.drop("error"), rows.where("error is not null").select("video_path", "kind", "error"), sources)
