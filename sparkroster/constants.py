"""Names and values shared by the operators."""

# Texts, keys, codes and limits that results must carry exactly.
NOT_AVAILABLE = "N/A"
NO_DISPLAY_NAME = "[No Display Name Label]"
INCONSISTENT_SUFFIX = " (Warning: Inconsistent display names for this ID)"
ELLIPSIS = "..."
DEFAULT_NAMESPACE = "default"
DEFAULT_ENVIRONMENT = "dev"
EMPTY_ENVIRONMENT = "env"
ID_PREFIX = "proj-"
ID_HEX_DIGITS = 12
RUN_SUFFIX_DIGITS = 8
NAME_LIMIT = 63
FILE_FIELD_PREFIX = "file_"
ENV_PARAM_PREFIX = "PARAM_"
ROLE_SCRIPT = "script"
KEY_CODE = "code"
KEY_TYPE = "scriptType"
KEY_ENGINE = "engine"
KEY_PARAMS_SPEC = "paramsSpec"
KEY_DESCRIPTION = "description"
TYPE_PYTHON = "PYTHON"
TYPE_PYSPARK = "PYSPARK"
TYPE_SQL = "SQL_SPARK"
ENGINE_DEFAULT = "K8S_JOB"
VALUE_PREVIEW = (70, 70)
DESCRIPTION_PREVIEW = (50, 47)
ERROR_BODY_PREVIEW = 500
RUN_TIMEOUT_SECONDS = 600
TAIL_LINES = 100
TAIL_LINES_FAILED = 50
SAMPLE_NAME_PREFIX = "ArgUser"
SAMPLE_FIRST_ID = 301
SAMPLE_FACTOR = 1.23
EXIT_REASONS = {
    1: "generic error",
    126: "command not executable",
    127: "command not found",
    137: "killed",
}

# Label and annotation keys of the inventory. They are this package's own; every
# function that reads a map takes other keys as an argument.
LABEL_COLUMNS = {
    "project_id": "project-id",
    "project_name": "project-name",
    "environment": "environment",
    "repo_name": "repo-name",
    "depends_on": "depends-on",
}
REPO_URL_ANNOTATION = "repo-url"
ROLE_LABEL = "role"
SCRIPT_PREFIX = "script-"
REPO_PREFIX = "project-"
RUN_PREFIX = "run-exec-"
