"""Errors with a stable code and structured context."""


class QuarryError(Exception):
    def __init__(self, code: str, **context):
        super().__init__(f"[{code}] " + ", ".join(f"{k}={v}" for k, v in context.items()))
        self.code, self.context = code, context
