"""Examples of an image and words: layouts of image tokens, ways to ask, and targets with loss weights, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import append, choose, filled, let
from quern.functions.geometry import inverse_permutation, patch_layout, token_positions
from quern.functions.prompts import instruction, separator, template

# The public wordings of a request for a caption.
PLAIN_STYLES = [
    "Here is an image\n",
    "Picture:\n",
    "Image:\n",
    "Examine this image:\n",
    "Look at this image:\n",
]
CAPTION_STYLES = [
    "Render a clear and concise summary of the photo.\n<image>",
    "Write a terse but informative summary of the picture.\n<image>",
    "<image>\nWhat is this?",
    "<image>\nRender a clear and concise summary of the photo.",
    "What is in the photo?\n<image>",
    "Describe the image concisely.\n<image>",
    "Share a concise interpretation of the image provided.\n<image>",
    "Give a brief description of the image.\n<image>",
    "<image>\nPresent a compact description of the photo's key features.",
    "<image>\nDescribe the image concisely.",
    "What is this?\n<image>",
    "<image>\nWrite a terse but informative summary of the picture.",
    "Provide a brief description of the given image.\n<image>",
    "Summarize the visual content of the image.\n<image>",
    "<image>\nWhat is in the photo?",
    "<image>\nProvide a brief description of the given image.",
    "Present a compact description of the photo's key features.\n<image>",
    "Give a short and clear explanation of the subsequent image.\n<image>",
    "<image>\nGive a short and clear explanation of the subsequent image.",
    "<image>\nGive a brief description of the image.",
    "<image>\nSummarize the visual content of the image.",
    "<image>\nShare a concise interpretation of the image provided.",
]
# Ways to lay an image out, and the special tokens it takes.
MODES = ("resize", "patchify", "patchify-and-resize", "patchify-v2", "patchify-v2-and-resize", "patchify-v2-and-resize-c2")
IMAGE_TOKENS = ("<im_start>", "<im_end>", "<im_patch>", "<im_col>")


def patch_order(rows: Column, cols: Column, height: int, width: int) -> Column:
    """For patches that come tile by tile, each tile row by row: their places when read across all tiles of a row of tiles."""
    n = height * width

    def place(i: Column) -> Column:
        tile, inner = F.floor(i / n), i % n
        above, beside, y, x = F.floor(tile / cols), tile % cols, F.floor(inner / width), inner % width
        return (above * cols * n + y * cols * width + beside * width + x).cast("int")

    return F.transform(F.sequence(F.lit(0), rows * cols * n - 1), place)


def image_layout(mode: str, rows: Column, cols: Column, height: int, width: int, ids: dict[str, int], ends: bool = True, columns: bool = True) -> tuple[Column, Column | None]:
    """Tokens of an image in ``rows`` by ``cols`` tiles of ``height`` by ``width`` patches, and the order of its patches (None: as they come).

    ``resize`` is one tile; ``-and-resize`` adds the image as a whole, after the tiles or with ``-c2`` before them; ``-v2``
    reads patches across tiles. With ``columns`` every row of patches ends in a column token.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {MODES}")
    start, end = (ids["<im_start>"], ids["<im_end>"]) if ends else (None, None)

    def grid(h: Column, w: Column) -> Column:
        if columns:
            return patch_layout(h, w, ids["<im_patch>"], ids["<im_col>"], start, end)
        body = F.array_repeat(F.lit(ids["<im_patch>"]), (h * w).cast("int"))
        return F.concat(F.array(F.lit(start)), body, F.array(F.lit(end))) if ends else body

    one = grid(F.lit(height), F.lit(width))
    if mode == "resize":
        return one, F.sequence(F.lit(0), F.lit(height * width - 1))
    tiles = grid((rows * height).cast("int"), (cols * width).cast("int"))
    tokens = F.concat(one, tiles) if "c2" in mode else F.concat(tiles, one) if "resize" in mode else tiles
    if "v2" not in mode:
        return tokens, None
    order = patch_order(rows, cols, height, width)
    if "c2" in mode:
        order = F.concat(F.sequence(F.lit(0), F.lit(height * width - 1)), F.transform(order, lambda v: v + height * width))
    elif "resize" in mode:
        order = F.concat(order, F.sequence((rows * cols * height * width).cast("int"), ((rows * cols + 1) * height * width - 1).cast("int")))
    return tokens, order


def request_prefix(style: str, image: Column, key: Column, encode: Callable[[Column], Column], image_text: Column | None = None, seed: int = 0) -> Column:
    """What stands before an answer: one wording of the style by hash of the key, and the image's tokens.

    ``image_text``: the image tokens as text, which ``mistral`` puts into its wording.
    """
    if style == "null":
        return image
    if style == "plain-v1":
        return F.concat(encode(choose(F.array(*map(F.lit, PLAIN_STYLES)), key, seed)), image)
    t = template(style)
    if style == "mistral":
        if image_text is None:
            raise ValueError("this style needs the image's tokens as text")
        wording = F.replace(choose(F.array(*map(F.lit, CAPTION_STYLES)), key, seed), F.lit("<image>"), image_text)
        return F.concat(encode(F.lit(t["B_INST"])), encode(wording), encode(F.lit(t["E_INST"])))
    if style == "vicuna_v1":
        return F.concat(encode(F.lit(t["SYS_PREFIX"] + t["B_INST"])), image)
    return F.concat(encode(F.lit(t["B_INST"] + t.get("SYS_PREFIX", ""))), image, encode(F.lit(t["E_INST"])))


def conversation_answer(turns: Column, style: str, encode: Callable[[Column], Column], image_text: Column | None = None) -> tuple[Column, Column]:
    """Tokens and loss weights of an array of turns (``from, value``): loss on the model's words and separators, never on token 0."""
    t = template(style)

    def parts(turn: Column) -> Column:
        value = turn["value"] if image_text is None else F.replace(turn["value"], F.lit("<image>"), image_text)
        head, body, tail = encode(instruction(turn["from"], t)), encode(value), encode(separator(turn["from"], t))
        loss = lambda x: F.transform(x, lambda v: F.when((v > 0) & (turn["from"] == "gpt"), 1).otherwise(0))
        return F.struct(F.concat(head, body, tail).alias("x"), F.concat(filled(0, F.size(head)), loss(body), loss(tail)).alias("m"))

    done = F.transform(turns, parts)
    return F.flatten(F.transform(done, lambda p: p["x"])), F.flatten(F.transform(done, lambda p: p["m"]))


def caption_answer(text: Column, encode: Callable[[Column], Column], eos: int) -> tuple[Column, Column]:
    tokens = append(encode(text), eos)
    return tokens, filled(1, F.size(tokens))


def example(prefix: Column, answer: tuple[Column, Column] | None, patch: int, order: Column | None, patches: int) -> dict[str, Column]:
    """``targets, decoder_loss_weights, image_input_idx``: prefix (no loss) and answer, and where each image's patches go.

    Without an answer it is a request to evaluate, without loss. ``order`` says at which place each patch is read.
    """
    targets = prefix if answer is None else F.concat(prefix, answer[0])
    weights = filled(0, F.size(prefix)) if answer is None else F.concat(filled(0, F.size(prefix)), answer[1])
    if order is None:
        places = token_positions(targets, patch, patches)
    else:
        flat = F.flatten(token_positions(targets, patch, 1))
        at = let(flat, lambda f: F.transform(inverse_permutation(order), lambda i: F.get(f, i)))
        places = let(at, lambda a: F.transform(F.sequence(F.lit(0), (F.size(a) / patches).cast("int") - 1), lambda r: F.slice(a, r * patches + 1, F.lit(patches))))
    return {"targets": targets, "decoder_loss_weights": weights, "image_input_idx": places}
