from plumbline.cli import main

main()
