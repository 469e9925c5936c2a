"""Fixed values and schemas of the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

#: Extension -> (kind, format, MIME type).
FORMATS = {
    "jpg": ("image", "jpeg", "image/jpeg"),
    "jpeg": ("image", "jpeg", "image/jpeg"),
    "png": ("image", "png", "image/png"),
    "webp": ("image", "webp", "image/webp"),
    "gif": ("animated", "gif", "image/gif"),
    "mp4": ("video", "mp4", "video/mp4"),
    "mov": ("video", "mov", "video/quicktime"),
    "mkv": ("video", "mkv", "video/x-matroska"),
    "avi": ("video", "avi", "video/x-msvideo"),
}
#: Directories that a walk skips, in lower case.
SYSTEM_DIRECTORIES = ("@eadir", ".thumbnails", "__macosx", "#recycle", "@recycle", ".trash", ".trashes", "$recycle.bin")
#: Limits.
MAX_IMAGE_BYTES, MAX_VIDEO_BYTES = 256 * 2**20, 2**40
MAX_SIDE, MAX_PIXELS = 32_768, 100_000_000
STORYBOARD_LEAST_MS = 2_000
MAX_TERM_LENGTH, DEFAULT_LIMIT, MAX_LIMIT = 256, 50, 200
MEDIA_ATTEMPTS, SCAN_ATTEMPTS, RECONCILE_ATTEMPTS = 3, 3, 5
HIGH_WATER, LOW_WATER = 90, 80
SAFE_FREE_BYTES = 512 * 2**20
MAX_LIBRARY_NAME = 128
QUIET_MS, CAP_MS = 750, 5_000

#: Why a scan ended; any other reason is the last of them.
SCAN_ERRORS = (
    "library_root_unavailable", "library_root_outside_allowed", "library_root_symlink", "library_root_mount_boundary", "library_root_identity_changed",
    "partial_tree_unreadable", "scan_io_error", "database_unavailable", "scan_interrupted", "internal_error",
)

LISTING = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("relative_path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("skipped", T.StringType()),
])
