from .build import main

main()
