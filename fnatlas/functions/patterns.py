"""The regular expressions and word lists that define labels and features.

They must equal those that the results are defined by, so each list is written out, in its natural order.
"""

from __future__ import annotations

import re

# Closed vocabularies and defaults.
CONTROL_FLOW = ("if", "for", "while", "switch", "goto", "return")
SIDE_EFFECTS = ("io", "memory", "hardware", "network", "global_state")
COMPLEXITIES = ("low", "medium", "high")
ERROR_HANDLING = ("returns_code", "uses_errno", "assertions")
NO_EFFECT, NO_ERRORS, NO_COMPLEXITY = "none", "none", "medium"

# Side effects, case-insensitive; one match suffices.
EFFECT_PATTERNS = {
    "io": [
        r"\bprintf\b", r"\bscanf\b", r"\bfprintf\b", r"\bfscanf\b", r"\bfopen\b", r"\bfclose\b", r"\bfread\b", r"\bfwrite\b",
        r"\bputs\b", r"\bgets\b", r"\bfgets\b", r"\bfputs\b", r"\bperror\b", r"\bgetchar\b", r"\bputchar\b",
    ],
    "memory": [
        r"\bmalloc\b", r"\bcalloc\b", r"\brealloc\b", r"\bfree\b", r"\bmemcpy\b", r"\bmemset\b", r"\bmemmove\b", r"\bstrdup\b",
        r"\bkmalloc\b", r"\bkfree\b", r"\bvmalloc\b", r"\balloca\b",
    ],
    "hardware": [
        r"\binb\b", r"\boutb\b", r"\binw\b", r"\boutw\b", r"\breadl\b", r"\bwritel\b", r"\bioread\b", r"\biowrite\b",
        r"\birq\b", r"\binterrupt\b", r"volatile\s+\w+\s*\*", r"->regs", r"__iomem", r"\bDMA\b", r"\bPCI\b", r"\bGPIO\b",
    ],
    "network": [
        r"\bsocket\b", r"\bconnect\b", r"\bbind\b", r"\blisten\b", r"\baccept\b", r"\bsend\b", r"\brecv\b", r"\bsendto\b",
        r"\brecvfrom\b", r"\bgetaddrinfo\b", r"\bgethostbyname\b", r"\binet_\w+\b", r"\bhtons\b", r"\bntohs\b",
    ],
    "global_state": [r"\bstatic\s+\w+\s+\w+\s*=", r"\bextern\b", r"\bg_\w+\b", r"\bs_\w+\b"],
}

# Error handling, case-insensitive, the first class with a match.
ERROR_PATTERNS = {
    "returns_code": [r"return\s+-1\b", r"return\s+NULL\b", r"return\s+0\b.*error", r"return\s+ERROR", r"return\s+FAIL", r"return\s+false\b"],
    "uses_errno": [r"\berrno\b", r"\bperror\b", r"\bstrerror\b"],
    "assertions": [r"\bassert\b", r"\bASSERT\b", r"\bBUG_ON\b", r"\bWARN_ON\b"],
}

# What a function's name says of its purpose, first hit first.
PURPOSE_VERBS = (("init", "Initializes"), ("get", "Retrieves"), ("set", "Sets"), ("read", "Reads"), ("write", "Writes"))
PURPOSE_FREE, PURPOSE_ALLOC = ("free", "destroy", "cleanup"), ("create", "alloc")

# Base features, case-sensitive.
MEMORY = [
    r"\bmalloc\s*\(", r"\bcalloc\s*\(", r"\brealloc\s*\(", r"\bfree\s*\(", r"\bmemset\s*\(", r"\bmemcpy\s*\(", r"\bmemmove\s*\(", r"\bstrdup\s*\(",
    r"\bnew\b", r"\bdelete\b",
]
IO = [
    r"\bprintf\s*\(", r"\bfprintf\s*\(", r"\bsprintf\s*\(", r"\bsnprintf\s*\(", r"\bputs\s*\(", r"\bfputs\s*\(", r"\bputchar\s*\(",
    r"\bscanf\s*\(", r"\bfscanf\s*\(", r"\bsscanf\s*\(", r"\bfopen\s*\(", r"\bfclose\s*\(", r"\bfread\s*\(", r"\bfwrite\s*\(",
    r"\bfgets\s*\(", r"\bfgetc\s*\(", r"\bgetchar\s*\(", r"\bopen\s*\(", r"\bclose\s*\(", r"\bread\s*\(", r"\bwrite\s*\(", r"\bFILE\s*\*",
]
HARDWARE = [
    r"\bioctl\s*\(", r"\bmmap\s*\(", r"\bmunmap\s*\(", r"\binb\s*\(", r"\boutb\s*\(", r"\binw\s*\(", r"\boutw\s*\(",
    r"\bvolatile\b", r"\bregister\b", r"->.*reg", r"\bport\b", r"\bhardware\b", r"\bdevice\b",
]
GLOBAL = [r"\bstatic\s+[^(]+;", r"\bglobal\b", r"\bextern\b", r"\bg_\w+", r"\bs_\w+"]
ERROR = [
    r"\berrno\b", r"\bperror\s*\(", r"\bstrerror\s*\(", r"\breturn\s+-1\b", r"\breturn\s+NULL\b", r"\breturn\s+0\b",
    r"\bassert\s*\(", r"\babort\s*\(", r"\bexit\s*\(", r"if\s*\([^)]*==\s*NULL", r"if\s*\([^)]*<\s*0", r"if\s*\(\s*!\w+\s*\)",
]
FUNC_CALL = r"\w+\s*\([^)]*\)"
CONTROL = r"\b(?:if|else|for|while|switch|case)\b"
POINTER = r"(?:\*\w+|\w+->\w+|&\w+)"
PARAMETERS = r"\([^)]*\)\s*\{"
RETURN = r"\breturn\b"
HAS_NULL, HAS_SIZEOF, HAS_STRUCT, HAS_ARRAY = r"\bNULL\b", r"\bsizeof\s*\(", r"\w+\.\w+|\w+->\w+", r"\w+\s*\[[^\]]+\]"

# Hardware features, case-sensitive.
MMIO = [
    r"\breadl\s*\(", r"\bwritel\s*\(", r"\breadw\s*\(", r"\bwritew\s*\(", r"\breadb\s*\(", r"\bwriteb\s*\(", r"\breadq\s*\(", r"\bwriteq\s*\(",
    r"\bioread32\s*\(", r"\biowrite32\s*\(", r"\bioread16\s*\(", r"\biowrite16\s*\(", r"\bioread8\s*\(", r"\biowrite8\s*\(", r"\b__iomem\b",
]
REGMAP = [
    r"\bregmap_read\s*\(", r"\bregmap_write\s*\(", r"\bregmap_update_bits\s*\(", r"\bregmap_bulk_read\s*\(", r"\bregmap_bulk_write\s*\(",
    r"\bregmap_set_bits\s*\(", r"\bregmap_clear_bits\s*\(", r"\bregmap_test_bits\s*\(",
]
IRQ = [
    r"\brequest_irq\s*\(", r"\bfree_irq\s*\(", r"\bdevm_request_irq\s*\(", r"\bdevm_request_threaded_irq\s*\(", r"\benable_irq\s*\(", r"\bdisable_irq\s*\(",
    r"\bdisable_irq_nosync\s*\(", r"\birq_set_irq_type\s*\(", r"\birq_to_desc\s*\(", r"\bhandle_level_irq\b", r"\bhandle_edge_irq\b",
]
SYNC = [
    r"\bspin_lock\s*\(", r"\bspin_unlock\s*\(", r"\bspin_lock_irqsave\s*\(", r"\bspin_unlock_irqrestore\s*\(", r"\bspin_lock_irq\s*\(", r"\bspin_unlock_irq\s*\(",
    r"\bmutex_lock\s*\(", r"\bmutex_unlock\s*\(", r"\batomic_read\s*\(", r"\batomic_set\s*\(", r"\batomic_inc\b", r"\batomic_dec\b",
    r"\bbarrier\s*\(", r"\bmb\s*\(", r"\bwmb\s*\(", r"\brmb\s*\(", r"\bsmp_mb\s*\(", r"\bsmp_wmb\s*\(", r"\bsmp_rmb\s*\(",
]
DEVM = [
    r"\bdevm_kzalloc\s*\(", r"\bdevm_kmalloc\s*\(", r"\bdevm_kcalloc\s*\(", r"\bdevm_ioremap\s*\(", r"\bdevm_ioremap_resource\s*\(",
    r"\bdevm_clk_get\s*\(", r"\bdevm_clk_get_enabled\s*\(", r"\bdevm_gpiod_get\s*\(", r"\bdevm_gpio_request\s*\(", r"\bdevm_regulator_get\s*\(",
    r"\bdevm_reset_control_get\s*\(", r"\bdevm_pinctrl_get\s*\(",
]
SPI = [
    r"\bspi_transfer\b", r"\bspi_message\b", r"\bspi_sync\s*\(", r"\bspi_write\s*\(", r"\bspi_read\s*\(", r"\bspi_write_then_read\s*\(",
    r"\bspi_register_driver\s*\(", r"\bspi_unregister_driver\s*\(",
]
I2C = [
    r"\bi2c_transfer\s*\(", r"\bi2c_master_send\s*\(", r"\bi2c_master_recv\s*\(", r"\bi2c_smbus_read_byte\s*\(", r"\bi2c_smbus_write_byte\s*\(",
    r"\bi2c_smbus_read_byte_data\s*\(", r"\bi2c_smbus_write_byte_data\s*\(", r"\bi2c_smbus_read_word_data\s*\(", r"\bi2c_smbus_write_word_data\s*\(",
    r"\bi2c_add_driver\s*\(", r"\bi2c_del_driver\s*\(",
]
GPIO = [
    r"\bgpio_get_value\s*\(", r"\bgpio_set_value\s*\(", r"\bgpio_direction_input\s*\(", r"\bgpio_direction_output\s*\(",
    r"\bgpiod_get_value\s*\(", r"\bgpiod_set_value\s*\(", r"\bgpiod_direction_input\s*\(", r"\bgpiod_direction_output\s*\(",
    r"\bgpiochip_get_data\s*\(", r"\bgpiochip_add_data\s*\(", r"\bdevm_gpiochip_add_data\s*\(",
]
WATCHDOG = [
    r"\bwatchdog_init_timeout\s*\(", r"\bwatchdog_register_device\s*\(", r"\bdevm_watchdog_register_device\s*\(", r"\bwatchdog_set_drvdata\s*\(",
    r"\bwatchdog_get_drvdata\s*\(", r"\bwatchdog_stop_on_reboot\s*\(", r"\bmod_timer\s*\(", r"\bsetup_timer\s*\(", r"\btimer_setup\s*\(",
    r"\bhrtimer_start\s*\(", r"\bhrtimer_init\s*\(",
]
BITWISE = [r"(?:<<|>>)\s*\d+", r"[&|]\s*0x[0-9a-fA-F]+", r"\bBIT\s*\(", r"\bGENMASK\s*\("]
LIFECYCLE = r"\b(?:probe|remove|suspend|resume|shutdown|init|exit|attach|detach)\s*\("
DEVICE_STRUCT = [
    r"\bplatform_device\b", r"\bpci_dev\b", r"\bi2c_client\b", r"\bspi_device\b", r"\busb_device\b", r"\bplatform_driver\b", r"\bi2c_driver\b", r"\bspi_driver\b",
]
MODULE_MACRO = [
    r"\bmodule_init\s*\(", r"\bmodule_exit\s*\(", r"\bMODULE_LICENSE\s*\(", r"\bMODULE_AUTHOR\s*\(", r"\bMODULE_DESCRIPTION\s*\(",
    r"\bmodule_platform_driver\s*\(", r"\bmodule_i2c_driver\s*\(", r"\bmodule_spi_driver\s*\(",
]
INLINE_ASM = [r"\b(?:__asm__|asm\s+volatile|__asm)\b"]
COMPILER_ATTR = [r"__attribute__\s*\(\(", "__packed", "__aligned", "__section", r"\blikely\s*\(", r"\bunlikely\s*\(", r"__force\b", r"__user\b", r"__kernel\b"]

#: Feature groups: name, patterns, cap of the count.
BASE_GROUPS = (("memory", MEMORY, 3), ("io", IO, 3), ("hardware", HARDWARE, 2), ("global", GLOBAL, 2), ("error", ERROR, 3))
HARDWARE_GROUPS = (("mmio", MMIO, 4), ("regmap", REGMAP, 3), ("irq", IRQ, 3), ("sync", SYNC, 4), ("devm", DEVM, 3))
PRESENT_GROUPS = (("spi", SPI), ("i2c", I2C), ("gpio", GPIO), ("wdt_timer", WATCHDOG))


#: Shapes of patterns that share what stands about a name, so names can be tried together.
_SHAPES = ((re.compile(r"\\b(\w+)\\b"), r"\b(?:{})\b"), (re.compile(r"\\b(\w+)\\s\*\\\("), r"\b(?:{})\s*\("))


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of them does; names with the same surroundings are put together."""
    names: dict[str, list[str]] = {}
    for p in patterns:
        for shape, out in _SHAPES:
            if m := shape.fullmatch(p):
                names.setdefault(out, []).append(m[1])
                break
        else:
            names[p] = []
    return "(?:" + "|".join(out.replace("{}", "|".join(found)) if found else out for out, found in names.items()) + ")"


def begins_with(pattern: str) -> str:
    """What any match of one of the patterns of effects and errors begins with, in lower case."""
    return re.match(r"(?:\\b)?([\w>-]+)", pattern)[1].lower()
