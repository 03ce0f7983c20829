"""Error codes that plans carry in columns, and the exceptions that actions raise."""

UNSUPPORTED_INTERVAL = "UNSUPPORTED_INTERVAL"
UNDECODABLE_BOUNDS = "UNDECODABLE_BOUNDS"
NULL_BOUND = "NULL_BOUND"
GAP = "GAP"
INCOHERENT_BOUNDS = "INCOHERENT_BOUNDS"
KEY_MISMATCH = "KEY_MISMATCH"
UNSUPPORTED_STRATEGY = "UNSUPPORTED_STRATEGY"
UNSUPPORTED_KEY_TYPE = "UNSUPPORTED_KEY_TYPE"
LAYOUT_MISMATCH = "LAYOUT_MISMATCH"
NOT_PARTITIONED = "NOT_PARTITIONED"
UNKNOWN_VERSION = "UNKNOWN_VERSION"
UNSUPPORTED_SERVER = "UNSUPPORTED_SERVER"
TIME_DRIFT = "TIME_DRIFT"
STATEMENT_TIMEOUT = "STATEMENT_TIMEOUT"
LOCK_TIMEOUT = "LOCK_TIMEOUT"

#: Process exit codes.
OK, BAD_CONFIG, INTERNAL, NO_CONNECTION, PROVISIONING_FAILED, CHECK_FAILED, CLEANUP_FAILED, BAD_WORK_DATE = range(8)


class RangeError(Exception):
    """An action or a plan failed; ``code`` says how."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class DetachPending(RangeError):
    """A detach was begun before and has not ended; it has to be finalised."""

    def __init__(self, detail: str = ""):
        super().__init__("DETACH_PENDING", detail)
