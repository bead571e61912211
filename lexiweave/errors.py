"""What can be wrong with languages, mappings and files. All are raised on the driver, while a plan is made."""


class EngineError(Exception):
    """Any of the errors below."""


class CommandLineError(EngineError):
    """Options that do not go together."""


class NeuralDependencyError(EngineError):
    """A neural mapping was asked for, and no model handler is registered."""


class MappingMissing(EngineError):
    def __init__(self, *wanted):
        super().__init__(f"there is no mapping for {' to '.join(map(str, wanted))}")


class NoPath(EngineError):
    def __init__(self, in_lang, out_lang):
        super().__init__(f"no path leads from {in_lang} to {out_lang}")


class InvalidNormalization(EngineError):
    def __init__(self, form):
        super().__init__(f"{form} is no normalisation; there are NFC, NFD, NFKC, NFKD and none")


class MalformedMapping(EngineError):
    """Rules, options or files that do not make a mapping."""


class MalformedLookbehind(MalformedMapping):
    """A context that cannot be looked behind for."""


class IncorrectFileType(EngineError):
    """A file of a kind that is not read or written here."""


class InvalidLanguageCode(EngineError):
    def __init__(self, code):
        super().__init__(f"{code} is no language of the network")


class RecursionError(EngineError):  # noqa: A001 (its public name)
    """Abbreviations that stand for each other in a circle, or too deep."""
