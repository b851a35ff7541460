from . import prompts, text  # noqa: F401
