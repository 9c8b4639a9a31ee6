"""Sinks: textures, JSON documents, ZIP bundles, and their guards."""

from __future__ import annotations

import json
import os
import zipfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.sources import images

ENCODERS = {"webp": images.webp, "png": images.png}


def texture_array(pixels: DataFrame) -> np.ndarray:
    """Height, width, 4 bytes. A texture is one image file, so its pixels come to the driver, partition by partition, as bytes."""
    w, h = (1 + v for v in pixels.agg(F.max("px"), F.max("py")).first())
    out = np.zeros((h * w, 4), np.uint8)
    for batch in pixels.select("ti", "r", "g", "b", "a").toArrow().to_batches():
        out[batch.column(0).to_numpy()] = np.stack([batch.column(k).to_numpy() for k in range(1, 5)], 1)
    return out.reshape(h, w, 4)


def write_bytes(folder: str, name: str, data: bytes) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def write_text(folder: str, name: str, text: str) -> str:
    return write_bytes(folder, name, text.encode())


def write_texture(folder: str, name: str, pixels: DataFrame, kind: str = "webp") -> str:
    return write_bytes(folder, f"{name}.{kind}", ENCODERS[kind](texture_array(pixels)))


def meta_json(meta: dict) -> str:
    return json.dumps(meta, indent=4, sort_keys=True)


def lod_meta_json(meta: dict) -> str:
    return json.dumps(meta, separators=(",", ":"), sort_keys=True)


def guard_bundle(path: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(f"{path} exists")


def guard_folder(path: str) -> None:
    if os.path.exists(path) and (not os.path.isdir(path) or os.listdir(path)):
        raise FileExistsError(f"{path} exists and is not an empty folder")


def write_zip(path: str, folder: str) -> None:
    """Files by name; images are stored, others deflated at level 9."""
    with zipfile.ZipFile(path, "x") as z:
        for name in sorted(os.listdir(folder)):
            stored = name.endswith((".webp", ".png"))
            z.write(os.path.join(folder, name), name, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED, None if stored else 9)


def read_zip(path: str) -> dict[str, bytes]:
    """Contents by name; damaged members raise."""
    with zipfile.ZipFile(path) as z:
        if bad := z.testzip():
            raise zipfile.BadZipFile(bad)
        return {n: z.read(n) for n in z.namelist()}
