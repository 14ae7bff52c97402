from locflow.cli import main

main()
