"""Jobs over tables: each module has a function that takes a session and paths, and a command line that creates and stops one."""
