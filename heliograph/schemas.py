"""Table schemas, domains, settings and the three kinds of error of the catalog."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


# Schemas are DDL texts, which readers take as they are: importing this module needs no session.
PHOTOS = (
    "id long, root_id int, path string, directory string, filename string, ext string, mime string, size_bytes long, mtime_ns long, width int, height int, "
    "captured_at timestamp_ntz, camera_make string, camera_model string, latitude double, longitude double, city string, region string, country string, "
    "place_distance_km float, exif string, sha256 string, phash long, status string, marked_for_deletion boolean, last_error string, created_at timestamp, updated_at timestamp"
)
SCAN_ROOTS = ("id int, path string, enabled boolean, created_at timestamp")
SCANS = (
    "id long, status string, root_ids array<int>, files_found int, files_processed int, files_added int, files_changed int, files_unchanged int, files_missing int, "
    "files_moved int, error_count int, current_path string, message string, started_at timestamp, finished_at timestamp, created_at timestamp"
)
SCAN_ERRORS = ("id long, scan_id long, path string, error string, created_at timestamp")
GROUPS = ("id long, kind string, key string, status string, keeper_photo_id long, created_at timestamp, updated_at timestamp")
MEMBERS = ("group_id long, photo_id long, similarity_pct int")
DECISIONS = ("group_id long, photo_id long, decision string, decided_at timestamp")
FILE_OPERATIONS = ("id long, photo_id long, op string, src_path string, dest_path string, size_bytes long, batch_id string, performed_at timestamp")
ORGANIZE_RUNS = (
    "id long, status string, params struct<folders: array<string>, destination: string, mode: string, rename: boolean, skip_duplicates: boolean>, batch_id string, "
    "total int, planned int, moved int, skipped_duplicates int, already_organized int, undated int, failed_count int, est_bytes long, message string"
)
DISCOVERED = ("path string, size_bytes long, mtime_ns long, error string")

# Fixed values of the catalog's domains.
PHOTO_STATUS = ("active", "missing", "quarantined")
GROUP_KIND = ("exact", "similar")
GROUP_STATUS = ("pending", "reviewed", "dismissed")
DECISION = ("keep", "remove")
FILE_OP = ("quarantine", "restore", "delete", "organize")
RUNNING = ("pending", "running")
ORGANIZE_MODE = ("date", "camera", "keep")
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "tif", "tiff")
CANONICAL = {"jpg": "jpeg", "tif": "tiff", "heif": "heic"}
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "heic": "image/heic", "heif": "image/heif", "tif": "image/tiff", "tiff": "image/tiff",
}
DEFAULT_MIME = "application/octet-stream"

LIST_COLUMNS = [
    "id", "root_id", "path", "filename", "ext", "mime", "size_bytes", "width", "height", "captured_at", "camera_make", "camera_model",
    "latitude", "longitude", "city", "region", "country", "place_distance_km", "status", "marked_for_deletion",
]
INFO_COLUMNS = ["id", "sha256", "phash", "size_bytes", "width", "height"]


@dataclass(frozen=True)
class Settings:
    """Engine settings; ``hamming`` keeps the guarantee of 8 byte bands only up to 7."""

    hamming: int = 6
    place_max_km: float = 100.0
    full_rebuild_share: float = 0.25
    thumbnail_size: int = 512

    def __post_init__(self):
        if not 0 <= self.hamming <= 7:
            raise ValidationFailed("the Hamming threshold is 0 to 7")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "HELIOGRAPH_") -> Settings:
        """Settings as the environment names them, HELIOGRAPH_HAMMING and so on; what it doesn't name keeps its default."""
        found = {}
        for f in fields(cls):
            text = (os.environ if env is None else env).get(prefix + f.name.upper())
            if text is not None and text.strip():
                try:
                    found[f.name] = type(f.default)(text)
                except ValueError as e:
                    raise ValidationFailed(f"{prefix}{f.name.upper()} is no {type(f.default).__name__}: {text}") from e
        return cls(**found)


class NotFound(Exception):
    """The named thing does not exist."""


class Conflict(Exception):
    """The state forbids the operation."""


class ValidationFailed(Exception):
    """The request makes no sense."""
