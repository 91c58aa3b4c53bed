"""Code-facts analytics on Spark: fact tables of a code base and the queries over them.

``quarry.model`` holds the fact schemas; ``sources`` fills them (from Go source trees, or from the
driver's tables); ``operators`` are functions from facts to DataFrames; ``plans`` has the iterative
ones' machinery; ``streaming`` the reload stream; ``tools`` the validated query surface.
"""
