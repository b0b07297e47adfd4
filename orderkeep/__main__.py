import sys

from orderkeep.cli import main

sys.exit(main())
