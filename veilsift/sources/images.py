"""Image bytes in tasks: metadata fields, pixels of PNG files, stripping, and a PNG writer for generated images.

The standard library is enough for these; JPEG pixels need a decoder that is not part of this package
and are read through Spark's image source (see operators.image_checks.with_pixels).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: A small file can unpack to any size: pixels beyond the first bound are not decoded, and of a packed text or profile no
#: more than the second is unpacked.
MAX_PIXEL_BYTES, MAX_FIELD_BYTES = 256 << 20, 16 << 20


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(marker, body, start, end) up to the start of the scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield data[at + 1], data[at + 4 : at + 2 + size], at, at + 2 + size
        at += 2 + size


# Names of EXIF tags that carry text, by directory; the thumbnail's directory, 1st, has the names of 0th.
TAG_NAMES = {
    "0th": {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x013B: "Artist", 0x02BC: "XMLPacket", 0x8298: "Copyright", 0x83BB: "IPTCNAA", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject"},
    "Exif": {0x9003: "DateTimeOriginal", 0x927C: "MakerNote", 0x9286: "UserComment", 0xA420: "ImageUniqueID", 0xA433: "LensMake", 0xA434: "LensModel"},
    "GPS": {0x001B: "GPSProcessingMethod", 0x001C: "GPSAreaInformation", 0x001D: "GPSDateStamp"},
}


def exif_places(tiff: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(directory, tag, start, end) of the byte and text values of a TIFF structure's directories."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return
    todo, done = [("0th", struct.unpack(order + "I", tiff[4:8])[0])], set()
    while todo:
        directory, at = todo.pop(0)
        if at in done or at < 8 or at + 2 > len(tiff):
            continue
        done.add(at)
        n = struct.unpack(order + "H", tiff[at : at + 2])[0]
        for start in range(at + 2, min(at + 2 + 12 * n, len(tiff) - 11), 12):
            tag, kind, count, value = struct.unpack(order + "HHII", tiff[start : start + 12])
            if tag in (0x8769, 0x8825):
                todo.append(("Exif" if tag == 0x8769 else "GPS", value))
            elif kind in (1, 2, 7):
                begin = start + 8 if count <= 4 else value
                yield directory, tag, begin, begin + count
        following = tiff[at + 2 + 12 * n : at + 6 + 12 * n]
        if directory in ("0th", "1st") and len(following) == 4:
            todo.append(("1st", struct.unpack(order + "I", following)[0]))


def exif_fields(tiff: bytes) -> list[tuple[str, bytes]]:
    """Byte and text values of a TIFF structure's directories, named by directory and tag."""
    tiff = tiff.removeprefix(b"Exif\0\0")
    name = lambda d, tag: TAG_NAMES["0th" if d == "1st" else d].get(tag, f"0x{tag:04X}")
    return [(f"{d}/{name(d, tag)}", tiff[start:end]) for d, tag, start, end in exif_places(tiff)]


def is_webp(data: bytes) -> bool:
    return data[:4] == b"RIFF" and data[8:12] == b"WEBP"


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def gif_blocks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of a GIF's blocks behind its header and colours: an extension's two bytes, an image's or the trailer's one."""
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = 13 + colours(data[10])
    while at < len(data):
        start, kind = at, data[at : at + (2 if data[at] == 0x21 else 1)]
        if data[at] == 0x21:
            at += 2
        elif data[at] == 0x2C:
            at += 11 + colours(data[at + 9])
        else:
            yield kind, start, len(data)
            return
        while data[at]:
            at += 1 + data[at]
        at += 1
        yield kind, start, at


def gif_text(data: bytes, start: int, end: int) -> bytes:
    """The text of an extension's parts."""
    out, at = [], start + 2
    while at < end and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    """Unpacked data, most bytes of it at most."""
    return zlib.decompressobj().decompress(data, max(1, most))


def metadata(data: bytes) -> list[tuple[str, bytes]]:
    """(field, value) of an image's metadata: EXIF tags of JPEG, PNG, WebP and TIFF, text chunks, packets, profiles and comments."""
    out: list[tuple[str, bytes]] = []
    try:
        if data.startswith(PNG):
            for kind, body in png_chunks(data):
                name, _, rest = body.partition(b"\0")
                if kind == b"tEXt":
                    out.append((name.decode("latin-1"), rest))
                elif kind == b"zTXt":
                    out.append((name.decode("latin-1"), inflate(rest[1:], MAX_FIELD_BYTES)))
                elif kind == b"iTXt" and len(rest) > 2:
                    text = rest[2:].split(b"\0", 2)[-1]
                    out.append((name.decode("latin-1"), inflate(text, MAX_FIELD_BYTES) if rest[0] else text))
                elif kind == b"eXIf":
                    out += exif_fields(body)
                elif kind == b"iCCP":
                    out.append(("icc_profile", inflate(rest[1:], MAX_FIELD_BYTES)))
        elif data.startswith(b"\xff\xd8\xff"):
            for marker, body, _, _ in jpeg_segments(data):
                if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                    out += exif_fields(body[6:])
                elif marker == 0xFE:
                    out.append(("comment", body))
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            out += [("comment", gif_text(data, start, end)) for kind, start, end in gif_blocks(data) if kind == b"\x21\xfe"]
        elif is_webp(data):
            for kind, body in riff_chunks(data):
                if kind == b"EXIF":
                    out += exif_fields(body)
                elif kind in (b"XMP ", b"ICCP"):
                    out.append(("xmp" if kind == b"XMP " else "icc_profile", body))
        elif data[:4] in (b"II*\0", b"MM\0*"):
            out += [f for f in exif_fields(data) if not f[0].startswith(("0th/0x", "1st/0x"))]
    except (struct.error, zlib.error, IndexError):
        pass
    return out


def png_pixels(data: bytes) -> np.ndarray | None:
    """Height x width x channels of an 8-bit PNG without interlacing, palette resolved; None for anything else, and for
    pictures whose header names more than MAX_PIXEL_BYTES."""
    try:
        head, packed, palette = None, [], None
        for kind, body in png_chunks(data):
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
        width, height, depth, color, _, _, interlace = head
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        size = height * (1 + width * n)
        if depth != 8 or interlace or size > MAX_PIXEL_BYTES:
            return None
        flat = np.frombuffer(inflate(b"".join(packed), size), np.uint8).reshape(height, 1 + width * n)
        pixels = unfiltered(flat[:, 0], flat[:, 1:].reshape(height, width, n))
        return palette[pixels[:, :, 0]] if palette is not None and color == 3 else pixels
    except (TypeError, KeyError, ValueError, struct.error, zlib.error, IndexError):
        return None


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The values of a PNG's lines (height x width x channels) from their differences, by each line's kind of filter.

    Where a line leans on values to its left and above at once, cells of one anti-diagonal need only earlier ones, so all
    lines advance together, a diagonal at a time.
    """
    height, width, n = lines.shape
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((height, width, n), np.uint8)
        for y in range(height):
            line = np.cumsum(lines[y], 0, dtype=np.uint8) if kinds[y] == 1 else lines[y]
            out[y] = line + out[y - 1] if kinds[y] == 2 and y else line
        return out
    padded = np.zeros((height + 1, width + 1, n), np.int16)
    flat, source = padded.reshape(-1, n), lines.astype(np.int16).reshape(-1, n)
    for t in range(width + height - 1):
        first, last = max(0, t - width + 1), min(height - 1, t)  # lines on this diagonal; line y is at column t - y
        count, kind = last - first + 1, kinds[first : last + 1, None]
        at = (first + 1) * (width + 1) + t - first + 1
        along = lambda start: flat[start : start + (count - 1) * width + 1 : width]  # noqa: B023, E731
        here, left, up, corner = along(at), along(at - 1), along(at - width - 1), along(at - width - 2)
        guess = left + up - corner
        to_left, to_up, to_corner = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        added = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        begin, step = first * width + t - first, max(1, width - 1)
        here[:] = (source[begin : begin + (count - 1) * step + 1 : step] + added) & 255
    return padded[1:, 1:].astype(np.uint8)


def source_pixels(image: dict) -> np.ndarray | None:
    """Height x width x channels, RGB or grey, of a row of Spark's image source, which keeps BGR(A) bytes."""
    n = image["nChannels"]
    px = np.frombuffer(image["data"], np.uint8)
    if n not in (1, 3, 4) or len(px) != image["height"] * image["width"] * n:
        return None
    px = px.reshape(image["height"], image["width"], n)
    return px if n == 1 else np.ascontiguousarray(px[:, :, 2::-1])


def write_png(pixels: np.ndarray, text: dict[str, str] | None = None) -> bytes:
    """An 8-bit RGB PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, _ = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    notes = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in (text or {}).items())
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + notes + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def strip_metadata(data: bytes) -> bytes:
    """Without PNG text, EXIF and time chunks, JPEG application and comment segments, WebP packets and profiles, GIF comments
    and applications (loops stay); a TIFF's texts become zeros. Other bytes stay, as do files that end in mid-structure."""
    try:
        return _stripped(data)
    except (struct.error, IndexError):
        return data


def _stripped(data: bytes) -> bytes:
    if data.startswith(PNG):
        out = PNG
        for kind, body in png_chunks(data):
            if kind in (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"gAMA", b"sRGB", b"cHRM"):
                out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return out
    if data.startswith(b"\xff\xd8\xff"):
        out, last = data[:2], 2
        for marker, _, start, end in jpeg_segments(data):
            if not (0xE1 <= marker <= 0xEF or marker == 0xFE):
                out += data[start:end]
            last = end
        return out + data[last:]
    if is_webp(data):
        body = b""
        for kind, chunk in riff_chunks(data):
            if kind == b"VP8X" and chunk:
                chunk = bytes([chunk[0] & ~0x2C]) + chunk[1:]  # its flags for profile, EXIF and packet
            if kind not in (b"EXIF", b"XMP ", b"ICCP"):
                body += kind + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) % 2)
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    if data[:6] in (b"GIF87a", b"GIF89a"):
        blocks = list(gif_blocks(data))
        gone = lambda kind, start, end: kind == b"\x21\xfe" or (kind == b"\x21\xff" and data[start + 3 : start + 14] != b"NETSCAPE2.0")
        return data[: blocks[0][1]] + b"".join(data[start:end] for kind, start, end in blocks if not gone(kind, start, end))
    if data[:4] in (b"II*\0", b"MM\0*"):
        out = bytearray(data)
        for directory, tag, start, end in exif_places(data):
            if directory in ("Exif", "GPS") or tag in TAG_NAMES["0th"]:
                out[start:end] = bytes(len(out[start:end]))
        return bytes(out)
    return data
