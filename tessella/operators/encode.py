"""Encoding images to vectors. The model is a plug-in: a function from a batch of arrays to patch tokens or vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import images as I
from tessella.operators.search import ship


@dataclass(frozen=True)
class Encoder:
    """tokens(batch, B x S x S x 3) is B x T x D: `prefix` global tokens (none: the mean stands in), then grid * grid patch tokens.

    A fixed_size model takes its native size only.
    """

    name: str
    tokens: Callable[[np.ndarray], np.ndarray]
    size: int
    grid: int
    prefix: int = 1
    fixed_size: bool = False
    pooler: Callable[[np.ndarray], np.ndarray] | None = None


REGISTRY: dict[str, Encoder] = {}


def device() -> str:
    """What a model in this task runs on: the accelerator that Spark gave the task, else the CPU."""
    from pyspark import TaskContext

    task = TaskContext.get()
    gpu = task.resources().get("gpu") if task else None
    return f"cuda:{gpu.addresses[0]}" if gpu and gpu.addresses else "cpu"


def profile(spark, gpus: float = 0.0, cores: int = 1):
    """A resource profile for encoding stages: a share of an accelerator for each task; None where none is asked for, so that any executor serves."""
    if not gpus:
        return None
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    wanted = ExecutorResourceRequests().cores(cores).resource("gpu", max(1, int(gpus)))
    return ResourceProfileBuilder().require(wanted).require(TaskResourceRequests().cpus(1).resource("gpu", gpus)).build


def corrupted(images: DataFrame, seed: int, recipe=I.sample_recipe) -> DataFrame:
    """query_id, image to the same with recipe (names and severities drawn by query_id and seed) and the image that it makes."""
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for q, row in zip(f["query_id"], f["image"], strict=True):
                rng = np.random.default_rng([seed, int(q) & (2**63 - 1)])
                steps = recipe(rng)
                img = I.from_struct(row)
                for name, severity in steps:
                    img = I.CORRUPTIONS[name](img, I.STRENGTH[name][severity - 1], rng)
                rows.append((int(q), "|".join(f"{n}:{v}" for n, v in steps), I.to_struct(img)))
            yield pd.DataFrame(rows, columns=["query_id", "recipe", "image"])

    return images.where(F.col("image").isNotNull()).select("query_id", "image").mapInPandas(run, f"query_id long, recipe string, image {images.schema['image'].dataType.simpleString()}")


def register(encoder: Encoder) -> Encoder:
    REGISTRY[encoder.name] = encoder
    return encoder


def encoder(name: str) -> Encoder:
    if name not in REGISTRY:
        raise ValueError(f"no encoder {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


@dataclass(frozen=True)
class Config:
    size: int | None = None
    pooling: str = "cls_patch"  # or cls
    flip: bool = False

    def size_for(self, e: Encoder) -> int:
        return e.size if e.fixed_size or not self.size else self.size


def write_pngs(photos: DataFrame, root: str) -> DataFrame:
    """filename, image to files below root, a folder that all executors mount; each is renamed into place. Returns the filenames as it writes."""
    import os
    import uuid

    ship(photos.sparkSession)
    root = root.removeprefix("file://")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, row in zip(f["filename"], f["image"], strict=True):
                path = f"{root}/{name}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as fh:
                    fh.write(I.png(I.from_struct(row)))
                os.replace(part, path)
            yield f[["filename"]]

    return photos.mapInPandas(run, "filename string")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def pooled(tokens: np.ndarray, e: Encoder, config: Config) -> np.ndarray:
    """The global descriptor, with the mean of the patches appended for cls_patch."""
    patches = tokens[:, e.prefix :]
    first = tokens[:, 0] if e.prefix else (e.pooler(tokens) if e.pooler else patches.mean(axis=1))
    return np.concatenate([first, patches.mean(axis=1)], axis=1) if config.pooling == "cls_patch" else first


def encode_batch(batch: np.ndarray, e: Encoder, config: Config) -> np.ndarray:
    """Unit vectors; with flip the elementwise maximum with the mirror image's."""
    out = unit(pooled(e.tokens(batch), e, config))
    if config.flip:
        out = unit(np.maximum(out, unit(pooled(e.tokens(batch[:, :, ::-1]), e, config))))
    return out.astype(np.float32)


def encode_views(images: DataFrame, e: Encoder, config: Config = Config(), mirrored: bool = False, trim: bool = True, batch: int = 32, gpus: float = 0.0) -> DataFrame:
    """item_id, view_id, image to item_id, view_id, mirrored, emb; a mirrored copy of each view if asked for. Null images are left out. gpus: of an accelerator for each task."""
    ship(images.sparkSession)
    side = config.size_for(e)
    rows = images.where(F.col("image").isNotNull()).select("item_id", "view_id", "image").withColumn("mirrored", F.explode(F.array(*[F.lit(x) for x in ((False, True) if mirrored else (False,))])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                g = f.iloc[i : i + batch]
                arrays = []
                for row, flip in zip(g["image"], g["mirrored"], strict=True):
                    a = I.from_struct(row)
                    a = I.trim_to_square(a, size=side)[0] if trim else I.resize(a, side, side, cubic=True)
                    arrays.append(a[:, ::-1] if flip else a)
                yield pd.DataFrame({"item_id": g["item_id"], "view_id": g["view_id"], "mirrored": g["mirrored"], "emb": list(encode_batch(np.stack(arrays), e, config))})

    return rows.mapInPandas(run, "item_id long, view_id int, mirrored boolean, emb array<float>", profile=profile(images.sparkSession, gpus))


def crops(img: np.ndarray, e: Encoder, config: Config, localised: bool) -> tuple[list[tuple[str, np.ndarray]], float | None]:
    """What a lookup encodes: the image, its localised crop if asked for, and the mirror image of the last of these; and the crop's share of the frame."""
    side = config.size_for(e)
    square = I.resize(img, side, side, cubic=True)
    if not localised:
        return [("image", square), ("mirror", square[:, ::-1])], None
    part, _, area = I.localise(img, e.tokens(square[None])[0, e.prefix :], e.grid)
    near = I.resize(part, side, side, cubic=True)
    return [("image", square), ("localised", near), ("mirror", near[:, ::-1])], area


QUERY_CROPS = "query_id long, crop string, emb array<float>, salient_area double, laplacian_var double, mean_luma double, luma_p05 double, luma_p95 double"


def encode_queries(images: DataFrame, e: Encoder, config: Config = Config(), localised: bool = True) -> DataFrame:
    """query_id, image to a row for each crop with its vector and the photo's features; feeds search.lookup. Null images are left out."""
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, row in zip(f["query_id"], f["image"], strict=True):
                img = I.from_struct(row)
                found, area = crops(img, e, config, localised)
                vectors = encode_batch(np.stack([c for _, c in found]), e, config)
                out += [(int(q), name, v, area, *I.quality(img)) for (name, _), v in zip(found, vectors, strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in QUERY_CROPS.split(", ")])

    return images.where(F.col("image").isNotNull()).select("query_id", "image").mapInPandas(run, QUERY_CROPS)


def lookup_path(spark, path: str, views: DataFrame, e: Encoder, config: Config = Config(), k: int = 5, localised: bool = True) -> DataFrame:
    """path, rank, item_id, score for each image under path."""
    from tessella.operators.search import lookup
    from tessella.sources.tables import read_images

    images = read_images(spark, path).withColumn("query_id", F.xxhash64("path"))
    found = lookup(encode_queries(images, e, config, localised), views, k)
    return found.join(images.select("query_id", "path"), "query_id").select("path", "rank", "item_id", "score")


def grid_tokens(batch: np.ndarray, grid: int = 4) -> np.ndarray:
    """A model without weights: a patch's token is the mean and deviation of its colours, the global token their mean. For tests and examples."""
    b, s = batch.shape[0], batch.shape[1] // grid
    p = batch[:, : s * grid, : s * grid].astype(np.float64).reshape(b, grid, s, grid, s, 3).transpose(0, 1, 3, 2, 4, 5).reshape(b, grid * grid, s * s, 3)
    patch = np.concatenate([p.mean(axis=2), p.std(axis=2)], axis=2) / 255.0
    return np.concatenate([patch.mean(axis=1, keepdims=True), patch], axis=1)


register(Encoder("colour-grid", grid_tokens, size=32, grid=4))
