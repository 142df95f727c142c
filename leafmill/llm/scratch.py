"""leafmill.scratch, by the name under which the operators here use it."""

import sys

from leafmill import scratch

sys.modules[__name__] = scratch
