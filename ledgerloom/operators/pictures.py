"""Pictures in tables: chains of kernels over raw grey bytes in one Arrow pass, a row's failure kept in the row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.functions import images, pictures

#: Kernels by the names of steps.
STEPS = {
    "resize": images.shrink, "denoise": pictures.denoised, "contrast": pictures.equalized, "deskew": pictures.deskewed, "sharpen": images.sharpen,
    "text_mask": pictures.text_mask, "ocr_enhance": pictures.ocr_enhanced,
}
#: The chain before recognition.
CHAIN = ("resize", "denoise", "contrast", "deskew", "sharpen")
LOAD = "load"
_ADDED = "made binary, made_width int, made_height int, failed_step string, step_error string"
_QUALITY = "quality struct<total_pixels:int,sharpness:double,brightness:double,contrast:double,aspect_ratio:double>"


def loaded(data: bytes | None, width: int | None, height: int | None) -> np.ndarray:
    if data is None or not width or not height or width < 0 or height < 0 or len(data) != width * height:
        raise ValueError("Could not load image")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def _run(data: bytes | None, width: int | None, height: int | None, steps: tuple[str, ...], options: dict[str, dict], measure: bool) -> tuple:
    step, quality = LOAD, None
    try:
        grey = loaded(data, width, height)
        if measure:
            found = images.quality(grey)
            quality = {k: found[k] for k in ("total_pixels", "sharpness", "brightness", "contrast", "aspect_ratio")}
        for step in steps:
            grey = STEPS[step](grey, **options.get(step, {}))
            grey = grey if grey.dtype == np.uint8 else pictures.bytes_of(grey)
        return grey.tobytes(), grey.shape[1], grey.shape[0], None, None, quality
    except Exception as e:  # one picture's failure is a value of its row
        return data, width, height, step, f"{type(e).__name__}: {e}"[:500], quality


def preprocessed(
    df: DataFrame, data: str = "data", width: str = "width", height: str = "height", steps: tuple[str, ...] = CHAIN, options: dict[str, dict] | None = None, measure: bool = False
) -> DataFrame:
    """Adds made, made_width, made_height, failed_step and step_error: the picture after the chain of steps.

    Where a step fails, or the bytes don't fit the sizes (step ``load``), ``made`` is the original and the step and its error are named; the other rows
    go on. ``options`` has arguments of steps, ``measure`` adds ``quality`` of the original. An unknown step is an error here, not in a task. Pictures of a batch are taken one by one.
    """
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    added = _ADDED + (f", {_QUALITY}" if measure else "")
    names = [x.split()[0] for x in added.replace(_QUALITY, "quality").split(", ")]
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns that the pass adds are there already: {', '.join(sorted(clash))}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + added
    given = options or {}
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.struct([("total_pixels", pa.int32()), *((k, pa.float64()) for k in ("sharpness", "brightness", "contrast", "aspect_ratio"))])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = zip(*(batch.column(c).to_pylist() for c in (data, width, height)))
                done = [_run(*row, steps, given, measure) for row in rows]
                made = [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)][: len(names)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
